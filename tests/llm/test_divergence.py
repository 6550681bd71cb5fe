import random
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """The audit's rows by plain loops; rows are (text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    often, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        often.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for at, t in often if at == lang and often[at, t] >= 3]

        def weights(n, kept=kept):
            total = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 1) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p = weights(counts[lang, source])
        pairs = []
        for at, other in counts:
            if at == lang and other != source:
                q = weights(counts[lang, other])
                pairs.append((other, sum(f(p[t], q[t]) for t in kept)))
        every = weights(sum((c for (at, _), c in counts.items() if at == lang), Counter()))
        terms = [(t, f(p[t], every[t])) for t in kept if counts[lang, source][t] and p[t] > every[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "zé", "東", "ó", "x-y", "q9q", "_r_", "ſ") for b in "abcdefgh"]
    rows = [(" ".join(rng.choices(words[: rng.choice([5, 60])], k=rng.randint(0, 40))), rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "É", None])) for _ in range(80)]
    many = " ".join("".join(c) for c in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 50)] * 3))  # over 200 terms after the next line
    rows += [(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}k" for k in range(300)), "en", s) for s in ("s0", "s0", "s0", "s1")]
    return [*rows, (many, "en", "s1"), (None, "en", "alone"), ("", "empty", "a"), ("only once", "empty", "b"), (None, None, None), ("Ab" * 60_000, "fr", "s1"), *[("twice the same row", "fr", "s0")] * 2]


@pytest.mark.parametrize(("seed", "held"), [(1, 400_000), (2, 7)])
def test_equals_plain_loops(spark, monkeypatch, seed, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "text string, lang string, source string, value double, item string").repartition(3)
    got = divergence.audit(docs)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_many_groups_shuffle(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = corpus(3)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect())) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert sorted(map(tuple, divergence.audit(odd_docs).collect())) == brute(rows)
    assert divergence.audit(no_docs).count() == 0


def test_weights_beyond_64_bits(spark):
    """Counts whose product with the scale needs more than 64 bits."""
    from pyspark.sql import functions as F

    n, total, kept = 10**13 + 7, 10**14 + 9, 12_345
    got = spark.createDataFrame([(n, total, kept)], "n long, t long, v long").select(divergence.weight(F.col("n"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + kept)
