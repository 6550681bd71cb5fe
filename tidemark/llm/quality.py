"""Operator 4: quality by weak supervision.

Rules look at a document's measures and vote for it (1), against it (-1) or
abstain (0). Nobody tells how good a rule is: expectation-maximisation finds,
from the counts of all vote patterns in the corpus, how often each rule votes
against bad and against good documents and how common bad ones are. A
document is kept if its posterior probability of being good is at least
KEEP. The counts are one row per pattern, at most 3 ** (number of rules), so
the fit runs on the driver however large the corpus is.

Words are runs of characters other than ASCII white space. Null texts count
as empty: no words, rejected. Repeated rows and null ids are judged one by
one; other columns are passed through by filter_documents() and ignored by
measure(); an empty table fits no model and gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

KEEP = 0.5
#: A rule is written to spare good documents: it votes against no more than this share of them.
MOST_FALSE = 0.02
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int
    n_letters: int
    n_shouts: int
    top_word: int
    n_word_like: int


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, upto = 0, 0
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered += k + WINDOW - max(upto, k)
            upto = k + WINDOW
    return covered


def letter_kinds() -> np.ndarray:
    """By code point: 0 no letter, 1 a letter, 2 a capital."""
    return np.array([c.isalpha() + (c.isalpha() and c.isupper()) for c in map(chr, range(0x110000))], np.uint8)


def measures(text: str) -> Measures:
    words = text.encode().split()
    lines = [s for s in text.split("\n") if s.strip(BLANKS)]
    kinds = common.lasting("letter kinds", letter_kinds)[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return Measures(
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int((kinds == 2).sum()),
        int((kinds > 0).sum()),
        text.count("!"),
        Counter(words).most_common(1)[0][1] if words else 0,
        sum(w[:1].isalpha() or w[0] > 127 for w in words),
    )


def between(value: float, good: float, bad: float) -> int:
    """A vote on a value: for up to good, against from bad on (or the other way round), none between."""
    if good > bad:
        value, good, bad = -value, -good, -bad
    return 1 if value <= good else -1 if value >= bad else 0


#: Each rule's vote by a text's measures with at least one word.
RULES = {
    "length": lambda m: between(m.n_words, 50, 5),
    "symbols": lambda m: between(m.n_symbols / m.n_words, 0.02, 0.1),
    "capitals": lambda m: between(m.n_upper / max(1, m.n_letters), 0.15, 0.3),
    "shouting": lambda m: between(m.n_shouts / m.n_words, 0.02, 0.1),
    "repeats": lambda m: between(m.n_repeat_words / m.n_words, 0.1, 0.3),
    "lines": lambda m: between(m.n_dup_lines / max(1, m.n_lines), 0.1, 0.4),
    "one_word": lambda m: between(m.top_word / m.n_words, 0.15, 0.3) if m.n_words >= MIN_WORDS else 0,
    "letters": lambda m: between(m.n_letters / m.word_chars, 0.88, 0.75),
    "word_like": lambda m: between(m.n_word_like / m.n_words, 0.9, 0.7),
}


def votes(m: Measures) -> str:
    """A character per rule: + for, - against, 0 abstains."""
    return "".join("0+-"[rule(m)] if m.n_words else "0" for rule in RULES.values())


class Model(NamedTuple):
    """prior: log odds of good. weights: per rule, what a vote for and a vote against add to them."""

    prior: float
    weights: tuple[tuple[float, float], ...]

    def posterior(self, pattern: str) -> float:
        odds = self.prior + sum(w["+-".index(v)] for v, w in zip(pattern, self.weights, strict=True) if v != "0")
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit_counts(counts: dict[str, int], rounds: int = 100, smoothing: float = 1.0) -> Model:
    """Expectation-maximisation over vote patterns; an abstention says nothing. A rule votes against bad texts no less often than against good ones."""
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], float)
    against = np.array([[v == "-" for v in p] for p in patterns], float)
    voted = np.array([[v != "0" for v in p] for p in patterns], float)
    good = np.where(against.any(axis=1), 0.2, 0.95)
    prior, log = 0.0, np.log
    bad_rate = good_rate = np.zeros(len(RULES))
    for _ in range(rounds):
        share = (n @ good + smoothing) / (n.sum() + 2 * smoothing)
        prior = float(log(share / (1 - share)))

        def rate(p: np.ndarray, fewer: float) -> np.ndarray:
            return ((n * p) @ against + smoothing * fewer) / ((n * p) @ voted + smoothing)

        good_rate, bad_rate = np.minimum(rate(good, MOST_FALSE / 2), MOST_FALSE), rate(1 - good, 0.5)
        bad_rate = np.maximum(bad_rate, good_rate)
        odds = prior + against @ log(good_rate / bad_rate) + (voted - against) @ log((1 - good_rate) / (1 - bad_rate))
        good = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    return Model(prior, tuple(zip(log((1 - good_rate) / (1 - bad_rate)).tolist(), log(good_rate / bad_rate).tolist(), strict=True)))


MEASURED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in Measures._fields[:5]), ("votes", pa.string())])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and votes of every document, in place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                m = measures(text.as_py() or "")
                yield (doc_id.as_py(), *m[:5], votes(m))

    fields = ", ".join(f"{n} long" for n in ("doc_id", *Measures._fields[:5])) + ", votes string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), MEASURED), fields)


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def fit(measured: DataFrame) -> Model:
    """The model of measure()'s rows: all of them, through the counts of their patterns."""
    return fit_counts({r["votes"]: r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()} or {"0" * len(RULES): 1})


def judge(measured: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """measure()'s rows with base_failed, quality (the posterior) and kept."""
    found = [(r["votes"], model.posterior(r["votes"])) for r in measured.select("votes").distinct().collect()]
    known = measured.sparkSession.createDataFrame(found, "votes string, quality double")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return measured.join(F.broadcast(known), "votes").select(
        *measured.columns, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= keep)).alias("kept")
    )  # `known` has at most 3 ** len(RULES) rows


def quality(docs: DataFrame) -> DataFrame:
    """judge() of documents by a model fitted on all of them. Measures are stored once, without the texts."""
    measured = common.stored(measure(docs), "quality")
    return judge(measured, fit(measured))


def filter_documents(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns. Texts are measured again rather than shuffled."""
    model = fit(common.stored(measure(docs).select("votes"), "votes"))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py() or "") for t in batch.column("text")]
            yield batch.filter(pa.array([not base_failed(m.n_words, m.n_repeat_words) and model.posterior(votes(m)) >= keep for m in found], pa.bool_()))

    return docs.transform(common.map_batches, stay, docs.schema)
