"""Which name holds a needle: an index of n-grams in place of comparing all names with all needles.

A needle of up to WHOLE characters is looked up as a gram of its own length,
with the first name that has that gram: names are cut only to the lengths that
needles have. A longer one is looked up by the rarest of its grams of WHOLE
characters, and the names that have that gram are verified. Needles and names
meet on an equal gram only; the rarest gram of a needle has the fewest names.

All joins are told to sort and merge: the size of a side is estimated from its
compressed file, so one of many rows would pass for small and be sent whole
through the driver.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters up to which a needle is itself a gram, and of the grams of longer ones.
WHOLE = 8


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters; none if the text is shorter."""
    places = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substring(text, k, F.lit(n))))


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that broadcasts no side."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def first_holding(names: DataFrame, needles: DataFrame, name: str, needle: str, order: str) -> DataFrame:
    """Each distinct needle with the first name, in order, that contains it: columns of names beside the needle.

    An empty needle is in all names; null needles and those without a match
    are dropped. Equal orders are told apart by the row, null orders come first.
    """
    wanted = needles.select(needle).where(F.col(needle).isNotNull()).distinct()
    lengths = [r[0] for r in wanted.select(F.least(F.char_length(needle), F.lit(WHOLE + 1))).distinct().collect()]  # at most WHOLE + 2 numbers
    named = names.where(F.col(name).isNotNull())
    at = F.col(needle)
    found = []

    # short needles: the least order of each gram of their length, summed up before the shuffle
    if short := sorted(n for n in lengths if n <= WHOLE):
        few = F.flatten(F.array(*(grams(F.col(name), n) if n else F.array(F.lit("")) for n in short)))
        least = named.select(F.explode(few).alias("_gram"), F.col(order).alias("_order")).groupBy("_gram").agg(F.min("_order").alias("_least"), F.max(F.col("_order").isNull()).alias("_null"))
        first = merged(wanted.where(F.char_length(at) <= WHOLE), least.withColumnRenamed("_gram", needle), needle)
        found.append(first.select(needle, F.when(~F.col("_null"), F.col("_least")).alias("_least")))

    # long needles: the names of the needle's rarest gram; a gram that no name has ends the search
    if max(lengths, default=0) > WHOLE:
        indexed = named.select(F.explode(grams(F.col(name), WHOLE)).alias("_gram"), F.col(order).alias("_order"), F.col(name).alias("_name"))
        longer = wanted.where(F.char_length(at) > WHOLE)
        asked = longer.select(needle, F.explode(grams(at, WHOLE)).alias("_gram"))
        rarest = merged(asked, indexed.groupBy("_gram").count(), "_gram", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "_gram")).alias("best"))
        held = merged(indexed, rarest.where("best.n > 0").select(needle, F.col("best._gram").alias("_gram")), "_gram").where(F.contains("_name", at))
        least = held.groupBy(needle).agg(F.min("_order").alias("_least"), F.max(F.col("_order").isNull()).alias("_null"))
        found.append(least.select(needle, F.when(~F.col("_null"), F.col("_least")).alias("_least")))

    if not found:
        return names.limit(0).select(F.lit("").alias(needle), *names.columns)
    # the rows of those orders: of equal ones, the least that contains the needle
    first = functools.reduce(DataFrame.unionByName, found)
    rows = named.select(F.col(order).alias("_at"), F.struct(*names.columns).alias("_row"))
    same = merged(first, rows, F.col("_least").eqNullSafe(F.col("_at"))).where(F.contains(F.col(f"_row.{name}"), at))
    return same.groupBy(needle).agg(F.min("_row").alias("_row")).select(needle, *(F.col(f"_row.{c}").alias(c) for c in names.columns))
