"""Operator 10: toxicity by class-conditional Kneser-Ney models.

A word counts for a class once per distinct word before it, as in Kneser-Ney
continuation counts, so neither repetition nor copied passages make evidence.
With N(c) such pairs in class c, a discount D(c) and the shared count of pairs
in either class,

    P1(w | c) = max(count(c, w) - D(c), 0) / N(c) + S * shared(w) / N(shared)

where S is the discounted mass. D is DISCOUNT for the toxic class, and that
for the ordinary class by which its mass is S too. So both are distributions
with the same backoff, and an expression too rare to pass the discounts has
the same probability in both and says nothing.

Above it is a level of word pairs that backs off to it. With n(c, v, w) the
distinct words that stand before `v w` in class c, n(c, v) their sum over w, and
f their quotient,

    P(w | v, c) = g(c, v) * max(f(c, v, w) - d(v), 0) + L(v) * R(w | v, c)
    R(w | v, c) = max(n(v, w) - DISCOUNT, 0) / n(v) + M(v) * P1(w | c)

d(v) is DISCOUNT by the smaller n(c, v), so the same share is taken of a pair in
both classes. L(v), the greater of the masses that they lose, is both classes'
backoff, and g(c, v) is such that each sums to 1; L is 1 where one class keeps
nothing. R is the level of the pairs of both classes together, n without c, and
M(v) the mass that it loses. A pair that passes no discount has the log ratio of
its word. Where a class has no habit after v, L is near 1 and pairs say little.

Words that both classes use, if not alike, outnumber telling ones by far and
add up to noise. So a log ratio below CLEAR of the greatest that is possible,
that of a word of toxic texts alone, counts as 0: both classes then take the
shared backoff. A document's evidence is the sum of the log ratios of its
words, divided by its length: the difference of its two length-normalised log
likelihoods. The same holds for pairs. A logistic curve turns it into the score. It is fitted on
documents scored by counts of the other half of the learning rows, so no
document vouches for itself.

Words hash to 2**BUCKET_BITS buckets, where two words seldom meet; a task is
sent at most that many (bucket, ratio) pairs, and the clear ratios of word
pairs: each passes the discount, so they are fewer than a third of the pairs of
the smaller class's documents for each class. All labelled learning rows are
counted and all rows scored; texts are never shuffled unless there are over
BROADCAST_ROWS labels.

Null texts are empty; an empty text has the score of no evidence. Labels that
are null or whose doc_id is null are skipped, of several for one doc_id the
largest counts. Repeated rows count once per distinct pair. Without labels of
both classes the score is the labels' share of toxic ones, 0 if none. Other
columns are ignored or passed through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

THRESHOLD = 0.7
BUCKET_BITS = 24
BEFORE_BITS = 63 - BUCKET_BITS
FIRST_BITS = 27
DISCOUNT = 3
CLEAR = 0.6
#: Words without evidence that are added to each document's length.
EXTRA_WORDS = 10
BROADCAST_ROWS = 1_000_000
PAIRS_HELD = 1 << 19
WORD = re.compile(r"\w+")


def remainder() -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 0 and 2 are the halves that learn. Null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """half (0 or 1), toxic and text of the documents that are learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = docs.select("doc_id", "text", remainder().alias("part")).where("part in (0, 2)")
    few = labels.select("doc_id").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(known) if few else known, "doc_id")
    return joined.select((F.col("part") / 2).cast("int").alias("half"), (F.col("label") > 0).cast("int").alias("toxic"), "text")


class Hashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pair_keys(words: list[str], hashes: Hashes) -> np.ndarray:
    """A key for each word with the word before it: the bucket above, the word before below."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
    return (h >> np.uint64(64 - BUCKET_BITS) << np.uint64(BEFORE_BITS) | before >> np.uint64(64 - BEFORE_BITS)).astype(np.int64)


#: The class and the half that learns, in the order of their bits.
SIDES = ("ord0", "tox0", "ord1", "tox1")
#: Columns of counts() and pair_counts() and the sides that they take together.
TOGETHER = {"ord": 5, "tox": 10, "ord0": 1, "tox0": 2, "ord1": 4, "tox1": 8, "shared": 15}


def pair_counts(learning: DataFrame) -> DataFrame:
    """key (a word with the word before it), its distinct words before (TOGETHER), and mask, the sides that have it."""
    schema = pa.schema([("key", pa.int64()), ("run", pa.int32())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, size = common.lasting("toxicity", Hashes), 0
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for half, toxic, text in zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                keys = pair_keys(words_of(text.as_py()), hashes)
                held.setdefault(2 * half + toxic, []).append(np.stack([keys, np.concatenate([[0], keys[:-1] >> (BEFORE_BITS - FIRST_BITS) & ((1 << FIRST_BITS) - 1)])[: len(keys)]]))
                size += len(keys)
            if size > PAIRS_HELD:
                yield from distinct_runs(held)
                held, size = {}, 0
        yield from distinct_runs(held)

    def distinct_runs(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for side, each in held.items():
            key, first = np.concatenate(each, axis=1)
            mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ first.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            order = np.argsort(mixed)
            at = order[np.diff(mixed[order], prepend=~mixed[order[:1]]) != 0]
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array((first[at] << 4 | 1 << side).astype(np.int32))], schema=schema)

    # dealt by key, so neither sum moves rows again
    each = learning.transform(common.map_batches, runs, "key long, run int").repartition("key")
    distinct = each.groupBy("key", F.shiftright("run", 4).alias("first")).agg(F.bit_or(F.col("run").bitwiseAND(F.lit(15))).alias("mask"))
    return distinct.groupBy("key").agg(*having("mask"), F.bit_or("mask").cast("byte").alias("mask"))


def having(mask: str) -> list[Column]:
    return [F.sum((F.col(mask).bitwiseAND(F.lit(bits)) != 0).cast("long")).alias(c) for c, bits in TOGETHER.items()]


def word_of() -> Column:
    return F.shiftrightunsigned("key", BEFORE_BITS).cast("int").alias("bucket")


def continuations(pairs: DataFrame) -> DataFrame:
    """bucket and its distinct pairs: ord, tox (all), ord0, tox0, ord1, tox1 (in a half), shared (in either class)."""
    return pairs.groupBy(word_of()).agg(*having("mask"))


def counts(learning: DataFrame) -> DataFrame:
    """continuations() of the learning documents' pairs."""
    return continuations(pair_counts(learning))


class Ratios(NamedTuple):
    """Buckets of words, or keys of pairs, with log ratios of their own, ascending, and those ratios."""

    buckets: np.ndarray
    values: np.ndarray


def equal_mass(found: DataFrame, column: str, total: int, mass: float) -> float:
    """The discount by which a column's counts lose a share `mass` of their total. Counts above 1024 are taken by bins of a hundredth."""
    c = F.col(column)
    bins = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c) * 64))
    rows = found.where(c > 0).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.sum(c).alias("sum")).collect()  # at most 1024 + 64 * 63 rows
    n, mean = np.array([r["n"] for r in rows], float), np.array([r["sum"] / r["n"] for r in rows])
    low, high = 0.0, float(mean.max())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * np.minimum(mean, middle)).sum() < mass * total else (low, middle)
    return high


class Words(NamedTuple):
    """What the models of single words are made of: the columns of both classes' probabilities, which words they tell apart, and from what log ratio on."""

    tox: Column
    ord: Column
    telling: Column
    clear: float


def words(found: DataFrame, tox: str, ord: str) -> Words | None:
    """The models of single words by the columns of the two classes in counts(); none without pairs of both."""
    lost = F.sum(F.least(F.col(tox), F.lit(DISCOUNT)))
    n = found.agg(F.sum(tox).alias("t"), F.sum(ord).alias("o"), F.sum("shared").alias("s"), lost.alias("lost")).first()
    if not n["t"] or not n["o"]:
        return None
    mass = n["lost"] / n["t"]
    other = equal_mass(found, ord, n["o"], mass)
    backoff = mass * F.col("shared") / n["s"]
    of = lambda c, d, total: F.greatest(F.col(c) - d, F.lit(0.0)) / total + backoff
    telling = ((F.col(tox) > DISCOUNT) | (F.col(ord) > other)) & (F.col("shared") > 0)
    return Words(of(tox, DISCOUNT, n["t"]), of(ord, other, n["o"]), telling, CLEAR * math.log(1 + n["s"] / (mass * n["t"])))


def collected(rows: DataFrame) -> Ratios:
    """The ratios of rows (a key, ratio)."""
    found = rows.toArrow()
    found = found.sort_by(found.column_names[0])
    return Ratios(found.column(0).to_numpy().astype(np.int64), found.column(1).to_numpy())


NONE = Ratios(np.empty(0, np.int64), np.empty(0, np.float64))


def ratios(found: DataFrame, w: Words | None) -> Ratios:
    """The clear log ratios of single words."""
    if w is None:
        return NONE
    return collected(found.where(w.telling).select("bucket", F.log(w.tox / w.ord).alias("ratio")).where(F.abs("ratio") >= w.clear))


def pair_models(pairs: DataFrame, found: DataFrame, w: Words, tox: str, ord: str) -> DataFrame:
    """key, p_tox, p_ord (a word's probability after the word before it), ratio and single (the word's own log ratio) of the pairs that pass the discount."""
    of = pairs.select("key", F.col("key").bitwiseAND(F.lit((1 << BEFORE_BITS) - 1)).alias("before"), F.col(tox).alias("t"), F.col(ord).alias("o"), (F.col(tox) + F.col(ord)).alias("s")).where("s > 0")
    lost = F.sum(F.least(F.col("s"), F.lit(DISCOUNT))) / F.sum("s")
    sums = of.groupBy("before").agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), F.sum("s").alias("ns"), lost.alias("lost"))
    # each class's discount is DISCOUNT or more, so what passes one has passed the shared one
    passed = of.where(F.col("s") > DISCOUNT).join(sums, "before")
    beyond = lambda c: F.coalesce(F.greatest(F.try_divide(c, f"n{c}") - F.try_divide(F.lit(float(DISCOUNT)), F.least("nt", "no")), F.lit(0.0)), F.lit(0.0))
    own = passed.select("key", "before", "lost", ((F.col("s") - DISCOUNT) / F.col("ns")).alias("s"), beyond("t").alias("t"), beyond("o").alias("o"))
    # what a class keeps after each word; the rest is its backoff
    kept = own.groupBy("before").agg(F.sum("t").alias("kt"), F.sum("o").alias("ko")).where("kt > 0 and ko > 0")
    single = found.select("bucket", w.tox.alias("wt"), w.ord.alias("wo"))
    joined = own.join(kept, "before", "left").withColumn("bucket", word_of()).join(single, "bucket")
    mass = F.coalesce(F.least("kt", "ko"), F.lit(0.0))
    p = lambda c: mass * F.coalesce(F.col(c) / F.col(f"k{c}"), F.lit(0.0)) + (1 - mass) * (F.col("s") + F.col("lost") * F.col(f"w{c}"))
    both = joined.select("key", p("t").alias("p_tox"), p("o").alias("p_ord"), F.log(F.col("wt") / F.col("wo")).alias("single"))
    return both.withColumn("ratio", F.log(F.col("p_tox") / F.col("p_ord")))


def pair_ratios(pairs: DataFrame, found: DataFrame, w: Words | None, tox: str, ord: str) -> Ratios:
    """The log ratios of the pairs that say something else than their word: clear ones, and 0 where only the word's is clear."""
    if w is None:
        return NONE
    clear = lambda c: F.abs(c) >= w.clear
    rows = pair_models(pairs, found, w, tox, ord).where(clear("ratio") | clear("single"))
    return collected(rows.select("key", F.when(clear("ratio"), F.col("ratio")).otherwise(0.0).alias("ratio")))


class Evidence(dict):
    """Word -> log ratio; forgets all when full, and doesn't keep long words."""

    def __init__(self, r: Ratios, limit: int = 100_000) -> None:
        self.r, self.limit = r, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        bucket = xxhash.xxh64_intdigest(word) >> (64 - BUCKET_BITS)
        at = int(np.searchsorted(self.r.buckets, bucket))
        out = float(self.r.values[at]) if at < len(self.r.buckets) and self.r.buckets[at] == bucket else 0.0
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str | None) -> float:
        """The difference of the length-normalised log likelihoods."""
        each = list(map(self.__getitem__, words_of(text)))
        return math.fsum(each) / (len(each) + EXTRA_WORDS)


class Likelihoods:
    """Both levels' evidence of texts: a pair's log ratio where it has one, else its word's."""

    def __init__(self, words: Ratios, pairs: Ratios) -> None:
        self.words, self.pairs, self.hashes = Evidence(words), pairs, Hashes()

    def of(self, text: str | None) -> float:
        """The difference of the length-normalised log likelihoods."""
        found = words_of(text)
        each = np.fromiter(map(self.words.__getitem__, found), np.float64, len(found))
        if len(self.pairs.buckets) and len(found):
            keys = pair_keys(found, self.hashes)
            at = np.minimum(np.searchsorted(self.pairs.buckets, keys), len(self.pairs.buckets) - 1)
            each = np.where(self.pairs.buckets[at] == keys, self.pairs.values[at], each)
        return math.fsum(each) / (len(each) + EXTRA_WORDS)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps on rows that stand for n documents, y of them toxic; a small ridge keeps them finite."""
    theta, ridge = np.zeros(x.shape[1]), 1e-3
    loss = lambda t: (n * np.logaddexp(0, x @ t) - y * (x @ t)).sum() + ridge * (t @ t) / 2
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - n * q) - ridge * theta
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        size = 1.0
        while size > 1e-6 and loss(theta + size * step) > loss(theta):
            size /= 2
        theta = theta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return theta


class Model(NamedTuple):
    ratios: Ratios
    theta: tuple[float, float] | None
    share: float
    pairs: Ratios = NONE

    def likelihoods(self) -> Likelihoods:
        return Likelihoods(self.ratios, self.pairs)

    def score(self, evidence: float) -> float:
        if self.theta is None:
            return self.share
        odds = self.theta[0] * evidence + self.theta[1]
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled documents that aren't held out."""
    learning = labelled(docs, labels)
    pairs = common.stored(pair_counts(learning), "toxicity-pairs")
    found = common.stored(continuations(pairs), "toxicity-counts")

    def levels(tox: str, ord: str) -> tuple[Ratios, Ratios]:
        model = words(found, tox, ord)
        return ratios(found, model), pair_ratios(pairs, found, model, tox, ord)

    # a document of one half is scored by the counts of the other
    other = [levels("tox1", "ord1"), levels("tox0", "ord0")]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        by = [Likelihoods(*r) for r in other]
        for batch in batches:
            for half, toxic, text in zip(batch.column("half").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                yield toxic, max(-4000, min(4000, round(1000 * by[half].of(text.as_py()))))

    schema = pa.schema([(n, pa.int64()) for n in ("toxic", "evidence")])
    grid = learning.transform(common.map_batches, lambda b: common.rows_to_batches(cells(b), schema), "toxic long, evidence long")
    rows = grid.groupBy("evidence").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("evidence").collect()  # at most 8001
    y, n = np.array([r["toxic"] for r in rows], float), np.array([r["n"] for r in rows], float)
    share = float(y.sum() / n.sum()) if len(n) else 0.0
    if share in (0.0, 1.0):
        return Model(NONE, None, share)
    x = np.array([[r["evidence"] / 1000, 1.0] for r in rows])
    single, pair = levels("tox", "ord")
    return Model(single, tuple(logistic(x, y, n).tolist()), share, pair)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, in place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        evidence = model.likelihoods()
        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id"), batch.column("held_out"), batch.column("text"), strict=True):
                s = model.score(evidence.of(text.as_py()))
                yield doc_id.as_py(), out.as_py(), s, int(s >= threshold)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return picked.transform(common.map_batches, lambda b: common.rows_to_batches(rows(b), SCORED), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    model = fit(docs, labels)

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = model.likelihoods()
        for batch in batches:
            yield batch.filter(pa.array([model.score(evidence.of(t.as_py())) < threshold for t in batch.column("text")], pa.bool_()))

    return docs.transform(common.map_batches, stay, docs.schema)
