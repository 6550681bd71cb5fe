import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentencepieces
from tidemark.llm.common import text_of

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("ab 's\n\t  .,1é東  　\x1c\x85\r\U0001f600'dte▁\0")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    return [t or "" for _, t in ODD] + ["".join(rng.choices(LETTERS, k=rng.randint(0, 50))) for _ in range(1500)]


def test_ids_and_spans(library):
    codec = sentencepieces.Codec(PATH, limit=100)
    for text, e in zip(texts(), codec.encode(texts())):
        assert e.ids.tolist() == library.encode(text), repr(text)
        data = text.encode()
        assert not data or (e.begins[0], e.ends[-1]) == (0, len(data))
        assert (e.begins[1:] == e.ends[:-1]).all()
        for k, b, t in zip(e.ids.tolist(), e.begins, e.ends):
            piece = library.id_to_piece(k)
            if not sentencepieces.BYTE.fullmatch(piece):
                got = data[b:t].replace("▁".encode(), b" ")
                want = piece.replace("▁", " ").encode()
                assert got == want or b == 0 and got == want[1:]


def test_spans_equal_the_librarys_own(library):
    codec = sentencepieces.Codec(PATH)
    for text in ["", "a  bc", "naïve café — 東京 x", " lead"]:
        own = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces if not sentencepieces.BYTE.fullmatch(p.piece)]
        e = codec.encode([text])[0]
        mine = [(b, t) for k, b, t in zip(e.ids.tolist(), e.begins, e.ends) if not sentencepieces.BYTE.fullmatch(library.id_to_piece(k))]
        assert mine == own


def char_map(rules):
    """A compiled map of the rules (bytes -> bytes): a double array with a block of 256 units per state."""
    strings, values = b"", {}
    for k, v in rules.items():
        values[k] = len(strings)
        strings += v + b"\0"
    states = sorted({k[:n] for k in rules for n in range(len(k) + 1)})
    base = {s: 256 * (n + 1) for n, s in enumerate(states)}
    units = [0] * (256 * (len(states) + 1))
    place = {b"": 0}

    def packed(offset):
        return offset << 10 if offset < 1 << 21 else (offset >> 8) << 10 | 1 << 9

    units[0] = packed(base[b""])
    for s in states:
        for t in states:
            if len(t) == len(s) + 1 and t.startswith(s):
                place[t] = base[s] ^ t[-1]
    for t in states[1:]:
        at = place[t]
        units[at] = packed(base[t] ^ at) | t[-1] | (1 << 8 if t in rules else 0)
        if t in rules:
            units[base[t]] = 0x80000000 | values[t]
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings


def test_char_map_takes_the_longest_prefix_and_keeps_origins():
    rules = {b"a": b"X", b"abc": b"YY", b"\xef\xbc\xa1": b"A", b"z": b""}
    m = sentencepieces.CharMap(char_map(rules))
    text = "abcab zＡé"
    plain, origin = m.normalise(text)
    assert plain == "YYXb Aé"
    assert origin == [0, 0, 3, 4, 5, 7, 10, 11, 12]


def test_model_with_a_map(tmp_path, library):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    rules = {"Ａ".encode(): b"A", "ﬁ".encode(): b"fi", b"\t": b" "}
    model.normalizer_spec.precompiled_charsmap = char_map(rules)
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    whole, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepieces.Codec(str(path))
    for text in ["Ａ ﬁne  day", "  \t lead", "tail  ", "", "   ", "plain"]:
        e = codec.encode([text])[0]
        assert e.ids.tolist() == whole.encode(text), repr(text)
        assert (e.begins <= e.ends).all() and (e.ends <= len(text.encode())).all()
    e = codec.encode(["Ａ ﬁne"])[0]
    assert e.ends[-1] == len("Ａ ﬁne".encode())


def test_query_columns(odd_docs, no_docs, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepieces.digests(odd_docs).collect())
    want = []
    for i, t in ODD:
        ids = library.encode(t or "")
        want.append((str(i), len(ids), sentencepieces.sha256(",".join(map(str, ids))), sentencepieces.sha256(library.decode(ids))))
    assert got == sorted(want)
    full = sentencepieces.encode_documents(odd_docs.where(text_of() != "")).collect()
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in full)
    assert sentencepieces.digests(no_docs).count() == 0
