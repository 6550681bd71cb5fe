"""Poll-and-diff ingestion as a stream: new rows only, alerts beside the table, a day's partition at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.cleaning import holds_any
from tidemark.operators.relational import new_rows, upsert
from tidemark.sources import store
from tidemark.sources.store import delete, exists, read_days, replace_days


def first_per_key(stream: DataFrame, keys: Sequence[str], time: str, keep: str = "1 day") -> DataFrame:
    """The stream's rows whose key hasn't been seen for `keep` of event time. Only keys are remembered, on the executors, and each goes when the watermark has passed it; null times are taken for late."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark(list(keys))


def ingest_once(stream: DataFrame, table: str, keys: Sequence[str], time: str, checkpoint: str, keep: str = "1 day") -> StreamingQuery:
    """Appends the first row of each key to the table, which is not read: what was seen is the query's own state.

    The table's log of batches and the query's checkpoint make each row appear
    once, also if the query stops between writing and committing; read the
    table by spark.read.parquet(), which goes by that log. A key is new again
    once `keep` of event time has passed since it was seen.
    """
    return first_per_key(stream, keys, time, keep).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def deliver(table: DataFrame, keys: Sequence[str], text: str, words: list[str], sink: Callable[[dict], None], marks: str, checkpoint: str) -> StreamingQuery:
    """Hands the table's rows with a keyword to the sink, one by one, each once. table: a stream of it.

    The table's log is the outbox: an alert is in it as soon as its row is, so
    none is lost while the sink is away. What the sink has taken of a batch is
    committed in `marks` row by row; a batch that broke off goes on behind it,
    in this run or the next. A row that the sink took just before the process
    ended is handed over again, so a sink that must not see it twice can go by
    its key. Rows with an equal key in a batch are one alert.
    """

    def hand_over(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = store.committed(spark, marks) or ["-1"]
        done = set(held[1:]) if held[0] == str(batch_id) else set()
        found = alerts(batch, text, words).dropDuplicates(list(keys)).orderBy(*keys)
        for row in found.toLocalIterator():  # a partition at a time; alerts are read by people
            record = row.asDict(recursive=True)
            key = json.dumps([record[k] for k in keys], default=str, ensure_ascii=False)
            if key in done:
                continue
            sink(record)
            done.add(key)
            number = store.commit(spark, marks, [str(batch_id), *sorted(done)])
            for old in store.commits(spark, marks):
                if old < number - 1:
                    store.delete(spark, f"{marks.rstrip('/')}/{store.COMMIT}{old:012}")

    return table.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    return rows.where(holds_any(F.col(text), words))


def ingest(
    stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str, on_alert: Callable[[DataFrame], None] | None = None, text: str | None = None, words: list[str] | None = None, day: str | None = None
) -> StreamingQuery:
    """Appends the rows of each micro-batch whose key the table doesn't have; alerts see those rows alone, once the table has them.

    day: a key that is a date. The table is then laid out by it, and a batch
    is compared with the days that it has rows of, not with the whole table.

    A batch that is run again after a failure finds its rows in the table and
    adds nothing, so nobody is alerted twice; an alert that fails is not
    repeated here (deliver() repeats it). The source's offsets advance only
    after the table has the rows. An append that broke off halfway leaves
    files that no reader sees, as they were never committed.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        known = spark.read.schema(batch.schema).parquet(table) if exists(spark, table) else batch.limit(0)
        if day is not None:
            # the batch's days prune the table's at run time, however many they are
            days = F.broadcast(batch.select(F.col(day).alias("_day")).distinct())
            known = known.join(days, F.col(day).eqNullSafe(F.col("_day")), "left_semi")
        # a cache would be made anew once the table has the rows, so they are put aside
        aside = f"{table.rstrip('/')}-batch-{uuid.uuid4().hex}"
        new_rows(fresh, known, keys).write.parquet(aside)
        new = spark.read.schema(batch.schema).parquet(aside)
        try:
            write = new.write.mode("append")
            (write if day is None else write.partitionBy(day)).parquet(table)
            if on_alert is not None and text and words:
                on_alert(alerts(new, text, words))
        finally:
            delete(spark, aside)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_days(rows: DataFrame, path: str, day: str, keys: Sequence[str], order: str, today: bool) -> None:
    """Writes each day's partition: rows replace it if it is today's, else they are merged in, the last of a key winning.

    Rows without a day are left out. Only the days that rows belong to are
    read and replaced, all in one commit; read them by store.read_days().
    """
    spark = rows.sparkSession
    dated = rows.where(F.col(day).isNotNull()).withColumn("date_key", F.date_format(day, "yyyy-MM-dd"))
    if not today:
        days = [r.date_key for r in dated.select("date_key").distinct().collect()]  # a write's days are few
        stored = read_days(spark, path, dated.schema, days)
        dated = upsert(stored.select(dated.columns), dated, [*keys, "date_key"], order).select(dated.columns)
    replace_days(dated, path)
