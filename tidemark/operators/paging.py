"""Pages of a whole table in one order, without a window over all rows.

numbered() deals the rows out by range and sorts each range; a row's number is
its place in its range plus the rows of the ranges before. Only the counts of
the ranges meet, one number a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import stored

#: monotonically_increasing_id() counts a task's rows in so many low bits.
TASK_BITS = 33


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Rows with their number in the order, from 0. Equal rows by the order are numbered as they come; name columns that tell them apart for the same numbers in every run.

    The ranges are stored once, as the borders that Spark samples may differ
    from run to run. Many equal keys share a range: with further columns in
    the order they are split too.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = stored(ranged, "numbered")
    task, place = F.shiftright("_id", TASK_BITS), F.col("_id").bitwiseAND((1 << TASK_BITS) - 1)
    counts = [(r.task, r.n) for r in held.groupBy(task.alias("task")).agg((F.max(place) + 1).alias("n")).collect()]  # a row a task
    before, starts = 0, []
    for k, n in sorted(counts):
        starts.append((k, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_task long, _before long")
    return held.join(F.broadcast(offsets), task == F.col("_task")).select(*rows.columns, (place + F.col("_before")).alias(name))


def pages(rows: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """Rows with their page of the whole table, from 0."""
    return numbered(rows, order, "_number").withColumn("page", F.floor(F.col("_number") / size).cast("bigint")).drop("_number")


def slice_rows(rows: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """The rows at offset .. offset + limit - 1 of the order, with their number."""
    return numbered(rows, order).where((F.col("number") >= offset) & (F.col("number") < offset + limit))


def until_empty(paged: DataFrame, keep: Column) -> DataFrame:
    """The kept rows of the pages before the first page of which no row is kept; a page is read only if it comes before that one."""
    n = paged.groupBy("page").agg(F.count_if(keep).alias("n"))
    cut = n.where("n = 0").agg(F.min("page")).first()[0]  # one number
    return paged.where(keep) if cut is None else paged.where(keep & (F.col("page") < cut))
