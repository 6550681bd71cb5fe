"""Relational operators of the disclosure flow: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(c: str, patterns: Sequence[str]) -> Column:
    """Whether a column matches one of the patterns, whatever the case; null and an empty list match nothing."""
    return F.coalesce(F.col(c).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def kept(rows: DataFrame, code: str, excluded: dict[str, Sequence[str]], place: tuple[str, str] | None = None) -> DataFrame:
    """Rows with a code, at the place if one is asked for, that match no exclusion."""
    keep = F.col(code).isNotNull()
    if place:
        keep &= F.trim(place[0]) == place[1]
    for c, patterns in excluded.items():
        keep &= ~any_of(c, patterns)
    return rows.where(keep)


def new_rows(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't stored; nulls are equal to one another."""
    have = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(have, same, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the last by (new, order), at the place of the first. `place` tells it; equal orders are told apart by the row."""
    rows = stored.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in ("_side", *keys)]
    at = F.struct("_side", order)
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), at).alias("row"), F.min(at).alias("place"))
    return found.select(*keys, "row.*", F.col("place._side").alias("place_side"), F.col(f"place.{order}").alias("place"))


def first_source(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """The rows of each key's first source that has any."""
    best = rows.groupBy(key).agg(F.min(priority).alias("_best"))
    return rows.join(best, key).where(F.col(priority) == F.col("_best")).drop("_best")


def take_while(rows: DataFrame, keep: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of each group before the first, in order, that isn't to be kept."""
    seen = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_stop", F.max(F.when(keep, 0).otherwise(1)).over(seen)).where("_stop = 0").drop("_stop")


def error_gate(rows: DataFrame, text: str, by: str, most: int = 5) -> DataFrame:
    """by, errors and passed: whether a batch may be stored. An error text begins with a marker and doesn't name a URL."""
    bad = F.col(text).rlike("(?i)^(Error[:：]|\\bError\\b)") & ~F.contains(F.col(text), F.lit("URL"))
    errors = F.count_if(F.coalesce(bad, F.lit(False)))
    return rows.groupBy(by).agg(errors.alias("errors")).withColumn("passed", F.col("errors") < most)


def next_day(days: DataFrame, day: str, ahead: int = 10) -> DataFrame:
    """Each distinct day with the next that has rows, at most `ahead` days on."""
    own = days.select(F.col(day).alias("day")).distinct()
    near = own.select("day", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("k")).select("day", F.date_add("day", F.col("k")).alias("next"))
    return near.join(own.withColumnRenamed("day", "next"), "next").groupBy("day").agg(F.min("next").alias("next_day"))


def paged(rows: DataFrame, order: Sequence[str], size: int, by: Sequence[str]) -> DataFrame:
    """Rows with their page number in each group, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def until_empty_page(rows: DataFrame, keep: Column, by: Sequence[str]) -> DataFrame:
    """The kept rows of the pages before a group's first page of which none is kept."""
    pages = rows.groupBy(*by, "page").agg(F.count_if(keep).alias("n"))
    cut = pages.where("n = 0").groupBy(*by).agg(F.min("page").alias("cut"))
    return rows.where(keep).join(cut, list(by), "left").where(F.col("cut").isNull() | (F.col("page") < F.col("cut"))).drop("cut")
