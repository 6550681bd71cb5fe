import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(doc_id, text, edited, next) by brute force."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def test_odd_rows(odd_docs, no_docs):
    got = fingerprints.compare_with_edits(odd_docs).collect()
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited(ODD))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(dict(ODD)[r.doc_id] or "", set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == len(r.edited_fingerprint) == fingerprints.BINS * fingerprints.BITS // 4
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text["   \n\t "] == by_text[""]
    assert fingerprints.compare_with_edits(no_docs).count() == 0


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize(("stride", "sampled"), [(1, 10**6), (7, 10**6), (10_000, 10**6), (7, 20), (1, 3)])
def test_next_over_many_ranges(spark, stride, sampled, monkeypatch):
    monkeypatch.setattr(fingerprints, "SAMPLED_IDS", sampled)
    rng = random.Random(stride)
    ids = rng.sample(range(-(10**15), 10**15), 200)
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next.doc_id for r in fingerprints.with_next(docs, stride).collect()}
    ids.sort()
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_likeness_follows_jaccard(spark):
    rng = random.Random(1)
    pairs = []
    for n in (1, 4, 6, 12, 40, 150, 900):
        for share in (0.0, 0.5, 0.9, 1.0):
            for _ in range(12):
                w = words(rng, n).split()
                cut = round(n * share)
                pairs.append((" ".join(w), " ".join(w[:cut] + words(rng, n - cut).split()) if cut < n else " ".join(w)))
    df = spark.createDataFrame(pairs, "a string, b string")
    near = fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))
    errors = {}
    for a, b, est in df.select("a", "b", near).collect():
        true = jaccard(a, b)
        errors.setdefault(len(a.split()), []).append(est - true)
        assert true < 1 or est == 1.0
        assert abs(est - true) < (0.2 if len(a.split()) >= 40 else 0.6)
    for n, e in errors.items():
        assert abs(sum(e) / len(e)) < 0.06, n


def plain_bins(hashes, hash_of):
    """One-permutation bins of 64-bit hashes, the empty ones filled, as their low bytes."""
    least = {}
    for h in hashes:
        h &= (1 << 64) - 1
        least.setdefault(h >> 56, []).append(h >> 16 & (1 << 40) - 1)
    least = {b: min(v) for b, v in least.items()}
    out = []
    for b in range(256):
        tries = [hash_of[b, t] % 256 for t in range(16)]
        last = min(least, key=lambda i: (hash_of[b, i] & 0x7FFFFFFF, i), default=None)
        at = next((k for k in [b, *tries, last] if k in least), None)
        out.append(255 if at is None else least[at] & 255)
    return out


def test_fingerprints_equal_brute_force(spark):
    """Bins, densification, packing and the correction for chance, from Spark's hashes of the shingles."""
    rng = random.Random(3)
    texts = ["", "one", *(words(rng, n) for n in (5, 6, 7, 9, 30, 120, 400, 2500))]
    texts += [texts[-1].replace("w1", "v1"), texts[-3] + " x y z"]
    pairs = spark.range(256).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    hash_of = {(b, i): h for b, i, h in pairs.select("b", "i", F.hash("b", "i")).collect()}
    text = F.col("text")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = df.select("k", fingerprints.shingle_hashes(text).alias("h"), fingerprints.as_string(fingerprints.fingerprint(text)).alias("fp")).orderBy("k").collect()
    bins = [plain_bins(r.h, hash_of) for r in got]
    for t, r, b in zip(texts, got, bins):
        assert len(set(r.h)) == len(shingles(t))
        assert r.fp == "".join(f"{x:02X}" for x in b)
    both = spark.createDataFrame([(a, b, texts[a], texts[b]) for a in range(len(texts)) for b in range(len(texts))], "a int, b int, s string, t string")
    near = fingerprints.likeness(fingerprints.fingerprint(F.col("s")), fingerprints.fingerprint(F.col("t")))
    for a, b, likeness in both.select("a", "b", near).collect():
        same = sum(x == y for x, y in zip(bins[a], bins[b])) / 256
        want = 1.0 if a == b else 0.0 if 0 in (a, b) else max(0.0, (same - 1 / 256) / (1 - 1 / 256))
        assert abs(likeness - want) < 1e-9


def test_plan_has_no_python_and_one_shuffle_of_texts(spark, odd_docs, capsys):
    fingerprints.compare_with_edits(odd_docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
