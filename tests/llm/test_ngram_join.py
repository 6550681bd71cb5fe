import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import components, ngram_join

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    """(doc_id, size, component, links to other sets) per row, by all pairs of sets."""
    sets = {}
    for i, t in rows:
        if (s := brute_set(t, n)) and i is not None:
            sets.setdefault(s, set()).add(i)
    forest, links = {s: s for s in sets}, Counter()

    def root(s):
        while forest[s] != s:
            s = forest[s]
        return s

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            forest[root(a)] = root(b)
            links[a] += 1
            links[b] += 1
    least = {}
    for s, ids in sets.items():
        least[root(s)] = min(least.get(root(s), min(ids)), min(ids))
    return Counter((i, len(s), (least[root(s)] if s in sets else i), links[s]) for i, t in rows for s in [brute_set(t, n)])


def corpus(seed, groups=14):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 40, 150]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.pop(k), lambda: w.insert(k, "new"), lambda: w.__setitem__(k, f"x{rng.randrange(9)}")])() if len(w) > 1 else None
            if rng.random() < 0.2:
                w[:0] = passage
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "chunk"), [(1, 3, 90, 1024), (2, 5, 80, 1024), (3, 2, 60, 3), (4, 3, 90, 4)])
def test_equals_all_pairs(spark, monkeypatch, seed, n, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", chunk)
    rows = corpus(seed)
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute(rows, n, percent)


def test_odd_rows(odd_docs, no_docs):
    got = ngram_join.similar(odd_docs, 3, 90).collect()
    want = Counter((i, s, None if i is None else c, k) for (i, s, c, k), m in brute(ODD, 3, 90).items() for _ in range(m))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == want
    assert ngram_join.similar(no_docs).count() == 0


def test_filter_keeps_one_of_each(odd_docs, no_docs):
    kept = ngram_join.filter_documents(odd_docs, 3, 90)
    assert kept.columns == odd_docs.columns
    # whoever leads its component stays, once; so do the wordless, and the null id without a counterpart
    leads = {i for i, _, component, _ in brute(ODD, 3, 90) if i is None or component == i}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, leads))
    assert ngram_join.filter_documents(no_docs).count() == 0


def test_a_repeated_row_merges_no_others(spark):
    """Wordless rows of one id and null-id rows of equal text all stay, whether or not another row is repeated."""
    rest = [(2, ""), (2, ""), (3, None), (3, None), (None, "no id has this text of words"), (None, "no id has this text of words"), (4, "one that stands alone among the others")]
    for rows in (rest, [*rest, (1, "a b c d e f g"), (1, "a b c d e f g")]):
        kept = ngram_join.filter_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
        assert Counter(map(tuple, kept.collect())) == Counter(rest) + Counter(set(rows) - set(rest))


def test_large_groups_share_no_row_of_pairs(spark):
    """A group of exact copies and one of near copies, both large: the chunked tasks find all links."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(300)] + [(1000 + k, " ".join(base[:k % 60] + [f"e{k}"] + base[k % 60 + 1 :])) for k in range(300)]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute(rows, 3, 80)


def test_blocks_miss_no_link():
    """Every linked pair of random sets shares a signature."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        levels = ngram_join.Levels.of(percent, 4000)
        for _ in range(300):
            size = int(rng.choice([1, 2, 5, 9, 10, 19, 20, 60, 300]))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            cut = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
            add = int(rng.integers(0, len(a) * (100 - percent) // percent + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, add).astype(np.uint64)]))
            out = np.sort(rng.permutation(np.union1d(a, b))[: int(rng.choice([0, size // 4, size]))])
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if len(b) and 100 * both >= percent * either:
                sides = [dict(zip(levels.of_size(len(x)), ngram_join.signatures(x, levels, out))) for x in (a, b)]
                level = levels.of_size(max(len(a), len(b)))[0]
                assert len(np.intersect1d(sides[0][level], sides[1][level]))


def test_a_set_signs_no_more_than_can_be_unlike():
    """One signature more than members in which a linked set can differ, at either level; none for a level that holds no partner."""
    rng = np.random.default_rng(4)
    none = np.empty(0, np.uint64)
    for percent in (80, 90):
        levels = ngram_join.Levels.of(percent, 4000)
        for size in (1, 2, 7, 60, 61, 400, 3000):
            members = np.unique(rng.integers(0, (1 << 64) - 1, size, dtype=np.uint64))
            for level, found in zip(levels.of_size(size), ngram_join.signatures(members, levels, none), strict=True):
                partners = [k for k in range(1, 5001) if levels.bounds[level] <= max(k, size) < levels.bounds[level + 1] and 100 * min(k, size) >= percent * max(k, size)]
                unlike = max(((k + size) * (100 - percent) // (100 + percent) for k in partners), default=-1)
                assert len(np.unique(found)) <= (2 if size < 400 else 1) * (unlike + 1)


@pytest.mark.parametrize(("n", "few"), [(1, 200_000), (70, 200_000), (70, 3), (2, 0)])
def test_components(spark, monkeypatch, n, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(n)
    ids = [k - 2**40 for k in rng.sample(range(2**41), n + 1)]
    chain = list(zip(ids, ids[1:])) + [(7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got) == set(ids) and set(got.values()) == {min(ids)}
