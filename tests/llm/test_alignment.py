import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

from .conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    """Functions from a text to (ids, bytes of each) by the libraries alone."""
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def a(text):
        e = t.encode(" " + text, add_special_tokens=False)
        return e.ids, [bytes(byte_of[c] for c in token) for token in e.tokens]

    def b(text):
        ids = s.encode(text)
        pieces = [s.id_to_piece(k) for k in ids]
        return ids, [bytes([int(p[3:5], 16)]) if s.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, pieces)]

    return a, b


def brute(texts, sides):
    """All columns but doc_id of each text, by comparing every token with every other."""
    found = []
    for text in texts:
        (a, a_bytes), (b, b_bytes) = sides[0](text or ""), sides[1](text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append(None)
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links, k = Counter(), 0
        for x, (s, e) in zip(a, spans[0]):
            while k < len(b) and spans[1][k][1] <= s:
                k += 1
            for y, (s2, e2) in zip(b[k:], spans[1][k:]):
                if s2 >= e:
                    break
                links[x, y] += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, own) if low <= s < high) for ids, own in zip((a, b), spans)) if len(ends) < 3000 else "")
            low = high
        found.append((len(a), len(b), len(ends), links, ";".join(groups)))
    count = Counter()
    for f in found:
        count.update(f[3].keys() if f else ())
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            links = f[3]
            yield (*f[:3], links.total(), sum(m for p, m in links.items() if count[p] == highest[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(f[4].encode()).hexdigest() if f[2] < 3000 else None)


def texts_of(seed):
    rng = random.Random(seed)
    letters = list("aabb 's\n\t  .,19é東  　\x1c\x85\r\x00\U0001f600'dte<0x41></s>▁")
    words = "the don't naïve café 東京東京 12345 x=1; <|endoftext|> <s> re-use ... http://a.b/c?d=e ÀÉÎ".split()
    out = ["".join(rng.choices(letters[: rng.choice([4, 12, len(letters)])], k=rng.randint(1, 40))) for _ in range(250)]
    out += [rng.choice([" ", " ", "\n", "  "]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(150)]
    return [*out, "東" * 900, "a" * 700, None, "", " ", "\n", "same text", "same text"]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"STRETCH_LINKS": 300, "HELD_POSTINGS": 200, "ID_POSTINGS": 20}), (3, {"AT_ONCE": 5})])
def test_equals_every_pair_of_tokens(spark, monkeypatch, sides, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    texts = texts_of(seed)
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_a long").repartition(5)
    got = sorted(map(tuple, alignment.align_documents(docs).collect()))
    want = list(brute(texts, sides))
    assert len(got) == len(want)
    for row, w, text in zip(got, want, texts):
        assert row[1:] == w, (text, row, w)


def test_odd_rows(odd_docs, no_docs, sides):
    got = Counter(tuple(r) if r.n_groups < 3000 else (*tuple(r)[:-1], None) for r in alignment.align_documents(odd_docs).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(ODD, brute([t for _, t in ODD], sides)))
    assert alignment.align_documents(no_docs).count() == 0


def test_long_unit_isnt_remembered():
    own = alignment.Aligner(A, B, 10)
    list(own.units(["x" * 5000, " ".join(f"w{k}" for k in range(500))]))
    assert all(len(k.encode()) <= alignment.UNIT_BYTES for k in own.known)
    list(own.units(["fresh words"]))
    assert len(own.known) <= 10
