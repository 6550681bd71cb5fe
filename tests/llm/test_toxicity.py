import math
import random
import zlib
from collections import Counter

import pytest

from tidemark.llm import toxicity

from .conftest import ODD

BAD = ["vile", "nasty", "rotten"]


def corpus(n=900):
    rng = random.Random(2)
    vocabulary = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(vocabulary, k=rng.randint(20, 80))
        toxic = k % 7 == 0
        for _ in range(1 + len(w) // 15 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((k, " ".join(w), "en", "s", len(w), 0.5))
        if k % 5:
            labels.append((k, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(None, "vile nasty", "en", "s", 1, 0.5), (7001, None, "en", "s", 0, 0.5), (7002, "", "en", "s", 0, 0.5), (7003, "word1 " * 20000, "en", "s", 0, 0.5), (7003, "word1 " * 20000, "en", "s", 0, 0.5)]
    labels += [(None, 1, 1), (7001, None, None), (1, None, 0), (99999, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_equal_brute_force(tables):
    docs, labels = tables
    got = {r.bucket: r for r in toxicity.counts(toxicity.labelled(docs, labels)).collect()}
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None:
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    pairs = {(h, t): set() for h in (0, 1) for t in (0, 1)}
    for r in docs.collect():
        part = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3
        if r.doc_id in known and part != 1:
            w = toxicity.words_of(r.text)
            pairs[part // 2, known[r.doc_id]] |= set(zip(["", *w], w))
    hashes = toxicity.Hashes()
    bucket = lambda w: hashes[w] >> (64 - toxicity.BUCKET_BITS)
    for name, parts in (("tox", [(0, 1), (1, 1)]), ("ord", [(0, 0), (1, 0)]), ("tox0", [(0, 1)]), ("ord1", [(1, 0)]), ("shared", list(pairs))):
        want = Counter(bucket(w) for _, w in set().union(*(pairs[p] for p in parts)))
        assert {b: r[name] for b, r in got.items() if r[name]} == want


def test_models_equal_brute_force(tables):
    """Both classes' probabilities sum to 1, their clear log ratios are the model's, and a document's evidence is the difference of its mean log likelihoods."""
    docs, labels = tables
    known = {}
    for r in labels.where("doc_id is not null and toxic is not null").collect():
        known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    pairs = {0: set(), 1: set()}
    for r in docs.where("doc_id is not null").collect():
        if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            w = toxicity.words_of(r.text)
            pairs[known[r.doc_id]] |= set(zip(["", *w], w))
    count = {c: Counter(w for _, w in p) for c, p in pairs.items()}
    shared = Counter(w for _, w in pairs[0] | pairs[1])
    total = {c: sum(n.values()) for c, n in count.items()}
    loss = lambda c, d: sum(min(n, d) for n in count[c].values()) / total[c]
    mass, low, high = loss(1, toxicity.DISCOUNT), 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if loss(0, middle) < mass else (low, middle)
    discount = {1: toxicity.DISCOUNT, 0: high}
    p = {c: {w: max(count[c][w] - discount[c], 0) / total[c] + mass * n / sum(shared.values()) for w, n in shared.items()} for c in (0, 1)}
    assert all(math.isclose(sum(x.values()), 1, abs_tol=1e-6) for x in p.values())
    ratio = {w: math.log(p[1][w] / p[0][w]) for w in shared}
    clear = toxicity.CLEAR * math.log(1 + sum(shared.values()) / (mass * total[1]))
    want = {w: x for w, x in ratio.items() if abs(x) >= clear}
    model = toxicity.fit(docs, labels)
    hashes = toxicity.Hashes()
    got = dict(zip(model.ratios.buckets.tolist(), model.ratios.values.tolist()))
    assert {hashes[w] >> (64 - toxicity.BUCKET_BITS) for w in want} == got.keys() and set(BAD) <= want.keys()
    evidence = toxicity.Evidence(model.ratios)
    for r in docs.limit(50).collect():
        w = toxicity.words_of(r.text)
        mean = sum(want.get(x, 0.0) for x in w) / (len(w) + toxicity.EXTRA_WORDS)
        assert math.isclose(evidence.of(r.text), mean, abs_tol=1e-6)
        assert math.isclose(model.score(mean), 1 / (1 + math.exp(-model.theta[0] * mean - model.theta[1])), abs_tol=1e-6)


def test_held_out_scores(tables):
    docs, labels = tables
    got = toxicity.toxicity(docs, labels).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 905
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and not math.isnan(r.score)
    out = [(any(b in (text[r.doc_id] or "") for b in BAD), r.predicted) for r in got if r.held_out]
    assert sum(p for bad, p in out if bad) >= 0.95 * sum(bad for bad, _ in out)
    assert sum(p for bad, p in out if not bad) <= 0.01 * len(out)
    assert {r.predicted for r in got if r.doc_id in (7001, 7002, 7003)} == {0}
    kept = toxicity.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)


def test_no_labels_or_one_class(tables, odd_docs, no_docs):
    docs, labels = tables
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.toxicity(odd_docs, labels).count() == len(ODD)


def test_against_labels_of_the_small_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(known[r.doc_id], r.predicted) for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert sum(p for t, p in got if t) >= 0.7 * sum(t for t, _ in got)
    assert sum(p for t, p in got if not t) <= 0.02 * len(got)


@pytest.fixture(scope="module")
def expressions(spark):
    """Words of both classes: only toxic texts have w7 after w3, where others have w9."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(900):
        w, toxic = rng.choices(vocabulary, k=60), k % 3 == 0
        w = [x for a, x in zip(["", *w], w) if (a, x) != ("w3", "w7")]
        for _ in range(6):
            at = rng.randrange(len(w))
            w[at:at] = ["w3", "w7" if toxic else "w9"]
        docs.append((k, " ".join(w), "en", "s", len(w)))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_an_expression_of_ordinary_words_is_found(expressions):
    docs, labels = expressions
    out = [(r.doc_id % 3 == 0, r.predicted) for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert sum(p for bad, p in out if bad) >= 0.9 * sum(bad for bad, _ in out)
    assert sum(p for bad, p in out if not bad) <= 0.02 * len(out)


def test_pairs_equal_brute_force(expressions):
    """Each pair's probability in both classes; what no pair says is its word's by the backoff, and all words after a word sum to 1."""
    docs, labels = expressions
    D, learning = toxicity.DISCOUNT, toxicity.labelled(docs, labels)
    pairs = toxicity.pair_counts(learning).cache()
    found = toxicity.continuations(pairs).cache()
    single = toxicity.words(found, "tox", "ord")
    hashes = toxicity.Hashes()
    bucket = lambda w: hashes[w] >> (64 - toxicity.BUCKET_BITS)
    p1 = {r.bucket: (r.o, r.t) for r in found.select("bucket", single.ord.alias("o"), single.tox.alias("t")).collect()}
    runs = {0: set(), 1: set()}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            w = toxicity.words_of(r.text)
            runs[int(r.doc_id % 3 == 0)] |= set(zip(["", "", *w], ["", *w], w))
    n = {c: Counter((v, w) for _, v, w in rows) for c, rows in runs.items()}
    got = {r.key: (r.p_ord, r.p_tox) for r in toxicity.pair_models(pairs, found, single, "tox", "ord").collect()}
    words = sorted({w for rows in runs.values() for _, _, w in rows})
    seen = 0
    for v in ["w3", "w7", "w11"]:
        total = {c: sum(n[c][v, w] for w in words) for c in n}
        both = {w: n[0][v, w] + n[1][v, w] for w in words}
        lost = sum(min(s, D) for s in both.values()) / sum(both.values())
        over = {c: {w: max(n[c][v, w] / total[c] - D / min(total.values()), 0) for w in words} for c in n}
        kept = {c: sum(x.values()) for c, x in over.items()}
        mass = min(kept.values())
        for c in n:
            p = {w: (mass * over[c][w] / kept[c] if mass else 0) + (1 - mass) * (max(both[w] - D, 0) / sum(both.values()) + lost * p1[bucket(w)][c]) for w in words}
            assert math.isclose(sum(p.values()), 1, abs_tol=1e-6)
            for w in words:
                key = int(toxicity.pair_keys([v, w], hashes)[1])
                if both[w] > D:
                    assert math.isclose(got[key][c], p[w], rel_tol=1e-9)
                    seen += 1
                else:
                    assert key not in got
    assert seen > 20
