"""Queries of the regressor and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regressor
from tidemark.plans import market
from tidemark.plans.catalogue import query
from tidemark.sources import entities
from tidemark.sources.store import shared_dir, stored
from tidemark.streaming import ingest


def samples(spark, sf_dir):
    """Embeddings as texts, with features and targets that follow from their label and id."""
    f = F.array(*(((F.col("vec_id") * k) % 7 / 7.0).cast("double") for k in range(1, 18)))
    t = F.array(*((F.col("label") * 0.1 + k * 0.01).cast("double") for k in range(9)))
    return entities.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("text_vector"), f.alias("features"), t.alias("targets"))


@query()
def mlp_forward(spark, sf_dir):
    """Predictions of fixed starting weights."""
    return regressor.predict(samples(spark, sf_dir), regressor.start(64, 17))


@query()
def mlp_fitted(spark, sf_dir):
    """Predictions after fitting on at most MOST_ROWS rows by a hash of id; the weights don't depend on tasks."""
    rows = samples(spark, sf_dir)
    weights, _ = regressor.fit(rows, epochs=3)
    return regressor.predict(rows, weights)


def training_rows(spark, sf_dir):
    """The work set with its documents as vectors."""
    return market.work_set(spark, sf_dir).select("id", regressor.hashed_words("document").alias("text_vector"), "features", "targets")


@query()
def work_set_rates(spark, sf_dir):
    """Rates of every disclosure of the work set, predicted by a network that is fitted on the whole of it: ten epochs in steps of 32 rows, on the executors."""
    rows = stored(training_rows(spark, sf_dir), "work-set")
    weights, _ = regressor.fit_rows(rows, epochs=10, batch=regressor.BATCH)
    return regressor.predict(rows, weights)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """The events' keys as a stream ingests them: each new key once."""
    rows = entities.table(spark, sf_dir, "events").select("user_id", "event_type")
    # a stream reads folders: the table written anew in two parts
    source, at = shared_dir(spark, "events"), shared_dir(spark, "stream")
    rows.repartition(2, "user_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ingest.ingest(stream, f"{at}/table", ["user_id", "event_type"], f"{at}/offsets").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/table")


@query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type")
def stream_first_seen(spark, sf_dir):
    """When each key was first seen, by a stream that remembers keys and reads no table; the events come in order of time."""
    rows = entities.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    source, at = shared_dir(spark, "events"), shared_dir(spark, "stream")
    first = rows.groupBy("user_id", "event_type").agg(F.min("at").alias("at"))
    # a run per delivery: the first events of all keys, then all of them; each is one batch of many files
    for delivery in (first, rows):
        delivery.select(rows.columns).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ingest.ingest_once(stream, f"{at}/table", ["user_id", "event_type"], "at", f"{at}/offsets", keep="3650 days").awaitTermination()
    return spark.read.parquet(f"{at}/table").select("user_id", "event_type", F.col("at").cast("timestamp_ntz").alias("ts"))
