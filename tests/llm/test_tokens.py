import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, pfor, token_files

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng = random.Random(5)
    letters = list("ab 's\n\t  .,1é東  　\x1c\x85\r\U0001f600'dte")
    encode = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50).encode
    for text in [t for _, t in ODD if t] + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), repr(text)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000, 300_000])
def test_blocks_round_trip(n, tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(n)
    ids = rng.choice([3, 200, 50_256, 2**32 - 1], n, p=[0.6, 0.37, 0.02, 0.01]).astype(np.uint32)
    cuts = [0, *sorted(rng.integers(0, n + 1, 9).tolist()), n]
    system, out = fs.LocalFileSystem(), str(tmp_path / "f")
    with system.open_output_stream(out) as f:
        w = pfor.Writer(f)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            w.add(None if k == 2 else k, ids[a:b].tobytes(), k // 4)
        w.close()
    with system.open_input_file(out) as f:
        r = pfor.Reader(f)
        for k, (key, doc, got) in enumerate(r):
            assert (key, doc) == (k // 4, None if k == 2 else k)
            assert (got == ids[cuts[k] : cuts[k + 1]]).all() and (r.ids(k) == got).all()


def brute_tokens(library):
    """(doc_id, ids with the end) in ascending order of id, null first."""
    return [(i, [*library(t), 0]) for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd_docs, no_docs, library):
    got = token_files.read_token_files(token_files.write_token_files(odd_docs), arrays=True).collect()
    want, at = [], 0
    for i, ids in brute_tokens(library):
        want.append((i, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(no_docs)).count() == 0


@pytest.mark.parametrize("mixture", [None, {"s0": 5.0, "s1": 1.0}])
def test_packing(odd_docs, no_docs, library, mixture):
    got = packing.pack(odd_docs, mixture=mixture).collect()
    texts = sorted((i is not None, i or 0, tuple(ids)) for i, ids in brute_tokens(library))
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for _, i, ids in {(a, b, c) for a, b, c in texts}:
        doc_id = None if (False, i, ids) in texts and i == 0 and len([1 for x in texts if x == (False, 0, ids)]) else i
        copies = texts.count((doc_id is not None, i, ids))
        own = sorted(pieces[doc_id, len(ids)], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in places:
        assert (s, o) == divmod(at, 1024) and o + n <= 1024
        at += n
    assert at == sum(len(ids) for _, ids in brute_tokens(library))
    assert packing.pack(no_docs).count() == 0


def simulated(totals, shares, window, turn):
    """The stream by deficit round-robin, step by step: the queue of each token."""
    weights = [max(1, round(s / sum(shares) * packing.SHARES)) for s in shares]
    left, deficit, stream = list(totals), [0] * len(totals), []
    while any(left):
        active = [q for q, n in enumerate(left) if n]
        whole = sum(weights[q] for q in active)
        for q in active:
            deficit[q] += max(1, window * packing.UNIT * weights[q] // whole)
            serve = left[q] if deficit[q] >= left[q] * packing.UNIT else deficit[q] // (turn * packing.UNIT) * turn
            deficit[q] -= serve * packing.UNIT
            left[q] -= serve
            stream += [q] * serve
    return np.array(stream)


@pytest.mark.parametrize("turn", [1, 7, 32])
@pytest.mark.parametrize(
    ("totals", "shares"),
    [
        ([4000, 2500, 500, 90, 1], None),
        ([4000, 2500, 500, 90, 1], [1, 1, 1, 1, 1]),
        ([3000, 3000], [1.0, 1e-7]),
        ([100, 5000, 31, 33, 64], [0.5, 0.01, 3, 1e-12, 2]),
        ([1], [5.0]),
        ([1] * 40 + [900], None),
    ],
)
def test_rounds_equal_a_simulation(totals, shares, turn):
    shares = totals if shares is None else shares
    rounds, want, rng = packing.Rounds(totals, shares, 64, turn), simulated(totals, shares, 64, turn), random.Random(turn)
    got = np.full(sum(totals), -1)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            lengths, room = [], n - at
            while room and len(lengths) < 5:
                lengths.append(rng.randint(1, min(room, rng.choice([1, 3, 40, 900]))))
                room -= lengths[-1]
            document, start, length, place = rounds.pieces(q, at, np.array(lengths))
            edges = [at, *(at + np.cumsum(lengths)).tolist()]
            assert start[0] == at and (start[1:] == (start + length)[:-1]).all() and (start + length)[-1] == edges[-1]
            for d, b, size, p in zip(document.tolist(), start.tolist(), length.tolist(), place.tolist()):
                assert edges[d] <= b < b + size <= edges[d + 1] and p // 64 == (p + size - 1) // 64 and size > 0
                assert (got[p : p + size] == -1).all()
                got[p : p + size] = q
                # tokens of a queue keep their order
                assert (want[:p] == q).sum() == b
            at = edges[-1]
    assert (got == want).all()


def test_windows_hold_the_mixture():
    totals = np.array([400_000, 250_000, 50_000, 900, 1], np.int64)
    rounds, filled = packing.Rounds(totals, totals), np.zeros((totals.sum() // 1024 + 1, 5), np.int64)
    for q, n in enumerate(totals):
        _, _, length, place = rounds.pieces(q, 0, np.array([n]))
        np.add.at(filled, (place // 1024, q), length)
    assert np.abs(filled[:-2] - 1024 * totals / totals.sum()).max() <= 2 * packing.TURN * len(totals)
    # a queue that ends leaves its share to the others, and a huge one keeps its places whole
    small = packing.Rounds([1000, 40 << 40, 20 << 40], [0.9, 0.05, 0.05])
    _, start, length, place = small.pieces(1, 10 << 40, np.array([100_000]))
    assert length.sum() == 100_000 and len(length) < 400 and (place > 20 << 40).all() and (np.diff(place) > 0).all()
    with pytest.raises(ValueError):
        packing.Rounds([5, 5], [1.0, 0.0])
    with pytest.raises(ValueError):
        packing.Rounds([5, 1 << 46], [1.0, 1.0])


def test_rare_sources_share_queues(spark, no_docs, monkeypatch):
    """Sources below the least share are pooled; the named one and the large one are queues of their own, unknown ones are ignored, and pieces tell their source."""
    monkeypatch.setattr(packing, "LEAST_SHARE", 0.25)
    monkeypatch.setattr(packing, "TAIL_QUEUES", 4)
    rows = [(k, "word " * 100, "large" if k % 3 == 0 else "named" if k % 3 == 1 and k % 2 else None if k == 5 else f"s{k}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, mixture={"named": 0.5, "large": 0.25, "unknown": 3.0}, window=256, turn=8).collect()
    assert {(r.doc_id, r.source) for r in got} == {(k, s) for k, _, s in rows}
    places = sorted((r.sequence_id * 256 + r.offset, r.length, r.source) for r in got)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
    early = Counter()
    for r in got:
        if r.sequence_id < 40:
            early[r.source if r.source in ("named", "large") else "tail"] += r.length
    tail = sum(len(t) for _, t, s in rows if s not in ("named", "large")) / sum(len(t) for _, t, _ in rows)
    shares = {"named": 0.5, "large": 0.25, "tail": tail}
    assert all(abs(early[s] / sum(early.values()) - w / sum(shares.values())) < 0.03 for s, w in shares.items())
    with pytest.raises(ValueError):
        packing.pack(docs, mixture={"named": 0.0})
    assert packing.pack(no_docs, mixture={"named": 1.0}).count() == 0
