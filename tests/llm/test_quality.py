import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import quality

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(s in lines[:k] for k, s in enumerate(lines)), len(inside)


LINES = "one two three four\nfive six seven eight nine ten\n\none two three four\n" * 3
TEXTS = [t for _, t in ODD if t is None or len(t) < 5000] + [LINES, "a b c d e f g h a b c d e f g h", "x " * 40, "<#*$%&|> \x0b\x0c\x1c é", "a b\x85c \x00"]


@pytest.mark.parametrize("text", TEXTS)
def test_measures_equal_brute_force(text):
    m = quality.measures(text or "")
    assert m[:5] == brute(text)
    assert m.n_letters == sum(map(str.isalpha, text or ""))


def test_every_odd_case_gets_a_row(spark, odd_docs, no_docs):
    got = quality.quality(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute(t)) for i, t in ODD)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(no_docs).count() == 0
    assert quality.filter_documents(no_docs).columns == no_docs.columns


def test_fit_finds_the_bad_cluster():
    """Two independent rules agree on the bad; one rule also errs on a few good."""
    rules = len(quality.RULES)
    good, bad = "+" * rules, "--" + "+" * (rules - 2)
    errs, none = "+-" + "+" * (rules - 2), "0" * rules
    m = quality.fit_counts({good: 8000, bad: 1500, errs: 40, none: 100})
    assert m.posterior(good) > 0.9 and m.posterior(bad) < 0.1 and m.posterior(none) > 0.5
    assert m.posterior(errs) > m.posterior(bad)


def plain_posteriors(patterns):
    """Expectation-maximisation document by document: the posterior of being good of each."""
    good = [0.2 if "-" in p else 0.95 for p in patterns]
    for _ in range(100):
        share = (sum(good) + 1) / (len(good) + 2)
        odds = [math.log(share / (1 - share))] * len(patterns)
        for rule in range(len(quality.RULES)):
            def rate(chance, start):
                voted = sum(c for c, p in zip(chance, patterns) if p[rule] != "0")
                return (sum(c for c, p in zip(chance, patterns) if p[rule] == "-") + start) / (voted + 1)

            of_good = min(rate(good, quality.MOST_FALSE / 2), quality.MOST_FALSE)
            of_bad = max(rate([1 - c for c in good], 0.5), of_good)
            vote = {"-": math.log(of_good / of_bad), "+": math.log((1 - of_good) / (1 - of_bad)), "0": 0.0}
            odds = [o + vote[p[rule]] for o, p in zip(odds, patterns)]
        good = [1 / (1 + math.exp(-o)) for o in odds]
    return good


def test_fit_equals_plain_loops():
    rng = random.Random(4)
    bad = [rng.random() < 0.2 for _ in range(300)]
    patterns = ["".join(rng.choices("+0-", (2, 2, 4) if b and k % 2 else (8, 2, 0.1))[0] for k in range(len(quality.RULES))) for b in bad]
    model = quality.fit_counts(Counter(patterns))
    want = plain_posteriors(patterns)
    assert all(math.isclose(model.posterior(p), w, abs_tol=1e-6) for p, w in zip(patterns, want))
    assert 30 < sum(w < quality.KEEP for w in want) < 100


def test_held_against_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    kept = {r.doc_id for r in quality.filter_documents(docs).select("doc_id").collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    judged = [(labels[i], r.kept) for i, r in rows.items() if i in labels and not r.base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
