"""Operator 3: document fingerprints by one-permutation MinHash, native.

Each shingle of SHINGLE words is hashed once; the hash names its bin and a
value in it, and the least value of every bin stays. An empty bin takes over
the value of the first non-empty bin in a random sequence that depends on the
bin alone and is the same for every document (optimal densification). The low
BITS bits of each bin are packed into 64-bit words. Of two unlike bins,
1 / 2**BITS agree by chance, which likeness() takes off.

Everything is a SQL function of one row: no shuffle, no Python. Equal texts
have equal fingerprints. A text of fewer than SHINGLE words is one shingle; a
text without words (or null) has the empty fingerprint of all ones, equal to
its like (likeness 1) and unlike all others (0). Repeated rows and null ids
are kept; other columns are ignored or, where asked for, carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SHINGLE = 5
BINS = 256
BITS = 8
TRIES = 16
VALUE_BITS = 40
PER_WORD = 64 // BITS
NONE = (1 << VALUE_BITS) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of `size` words, or of all words if fewer."""
    words = F.filter(F.split(text, common.WORD_GAP), lambda w: w != "")

    def runs(h: Column) -> Column:
        last = F.greatest(F.size(h) - size, F.lit(0))
        whole = F.xxhash64(*(F.get(h, F.lit(k)) for k in range(size)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) <= size, F.array(whole)).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def binned(hashes: Column) -> Column:
    """The least value of each bin in the order of bins, NONE where empty. A hash's top byte is its bin."""
    keyed = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - VALUE_BITS - int(math.log2(BINS))))
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), VALUE_BITS).bitwiseOR(F.lit(NONE)))

    def firsts(a: Column) -> Column:
        of = lambda x: F.shiftright(x, VALUE_BITS)
        kept = F.filter(a, lambda x, i: (i == 0) | (of(x) != of(F.get(a, F.greatest(i - 1, F.lit(0))))))
        return F.transform(kept, lambda x: x.bitwiseAND(F.lit(NONE)))

    return let(F.sort_array(F.concat(keyed, ends)), firsts)


def densified(bins: Column) -> Column:
    """Empty bins filled; all empty stays all NONE.

    An empty bin tries TRIES bins of its sequence one by one. If all are empty,
    as happens in short texts, the full bin of the least hash with it is next
    in the sequence.
    """
    probe = lambda v, b, t: F.get(v, F.pmod(F.hash(b, F.lit(t)), F.lit(BINS)))
    rank = lambda b, i: F.shiftleft(F.hash(b, i).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF)), 16).bitwiseOR(i.cast("bigint"))

    def filled(v: Column) -> Column:
        def fill(full: Column) -> Column:
            least = lambda b: F.array_min(F.transform(full, lambda i: rank(b, i))).bitwiseAND(F.lit(0xFFFF)).cast("int")
            each = F.transform(v, lambda x, b: F.coalesce(x, *(probe(v, b, t) for t in range(TRIES)), F.get(v, least(b))))
            return F.when(F.size(full) == 0, F.transform(v, lambda _: F.lit(NONE))).when(F.size(full) == BINS, v).otherwise(each)

        return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(v, i).isNotNull()), fill)

    return let(F.transform(bins, lambda x: F.nullif(x, F.lit(NONE))), filled)


def packed(bins: Column) -> Column:
    """The low bits of all bins as 64-bit words."""
    word = lambda v, w: F.aggregate(
        F.slice(v, w * PER_WORD + 1, F.lit(PER_WORD)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1)))
    )
    return let(bins, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda w: word(v, w)))


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """The packed words, array<bigint>."""
    return packed(densified(binned(shingle_hashes(text, size))))


def as_string(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def unlike(x: Column) -> Column:
    """Bins that differ, from the exclusive or of two words: each bin's bits are folded onto its lowest."""
    def folded(step: int) -> Callable[[Column], Column]:
        return lambda y: y.bitwiseOR(F.shiftrightunsigned(y, step))

    y = let(let(let(x, folded(4)), folded(2)), folded(1))
    return F.bit_count(y.bitwiseAND(F.lit(0x0101010101010101)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two fingerprints, chance agreement taken off."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / (1 << BITS)
    empty = lambda v: F.forall(v, lambda x: x == -1)
    return (
        F.when(a == b, F.lit(1.0))
        .when(empty(a) | empty(b), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance)))
    )


#: Documents between two boundaries of with_next(), the most boundaries, and about how many ids are sent to the driver to find them.
STRIDE, MOST_STRIDES, SAMPLED_IDS = 1000, 100_000, 1_000_000


def with_next(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Each row with `next`: the row after it in ascending order of doc_id, nulls first (ties by text), after the last the first.

    The ids are cut into ranges at the quantiles of a sample by hash, which are
    ids of the table, and one shuffle brings each range together. The first row
    of a range goes to the range before it as well, behind its last row, so no
    row needs another range. The sample has about SAMPLED_IDS ids at most,
    whatever the table's size, and decides on nothing but the ranges' sizes.
    At most MOST_STRIDES boundaries exist; beyond, ranges grow and sort with
    spilling.
    """
    order = ["doc_id", F.xxhash64("text"), "text"]
    n, low = docs.agg(F.count("*"), F.min("doc_id")).first()
    strides = max(1, min(MOST_STRIDES, n // stride))
    picked = docs.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLED_IDS))) == 0)
    ids = np.unique(picked.select(F.col("doc_id").cast("long").alias("doc_id")).toArrow().column("doc_id").to_numpy())
    places = np.linspace(0, len(ids), strides + 2)[1:-1].astype(np.int64) if len(ids) else []
    cuts = sorted({low, *(ids[places].tolist() if len(ids) else [])} - {None}) or [0]
    steps = max(1, len(cuts)).bit_length()
    known = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded into one literal
    # binary search: the number of boundaries up to the id, less one; null ids are before all
    search = F.aggregate(
        F.array(*(F.lit(1 << k) for k in reversed(range(steps)))),
        F.lit(0),
        lambda at, step: F.when((at + step < len(cuts)) & (F.get(known, at + step) <= F.col("doc_id")), at + step).otherwise(at),
    )
    here = docs.withColumn("_range", search).withColumn("_first", F.coalesce(F.get(known, F.col("_range")) == F.col("doc_id"), F.lit(True)))
    twice = F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("_range") - 1, F.lit(len(cuts))).alias("range"), F.lit(1).alias("guest")))
    spread = here.select(*docs.columns, F.explode(F.when(F.col("_first"), twice).otherwise(F.slice(twice, 1, 1))).alias("_at"))
    ordered = Window.partitionBy("_at.range").orderBy("_at.guest", *order)
    row = F.struct(*docs.columns)
    return spread.withColumn("next", F.lead(row).over(ordered)).where("_at.guest = 0").drop("_at")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text is the document with its second half replaced by the beginning of the next one.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("fp", fingerprint(F.col("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    both = with_next(marked).select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    done = both.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
