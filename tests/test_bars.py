"""How bars are made: by hash, after one shuffle by code."""

from pyspark.sql import functions as F

from tidemark.operators import prices, recurrences, training
from tidemark.plans.registry import QUERIES
from tidemark.sources import entities

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trades_are_shuffled_once_and_not_sorted_for_bars(spark):
    for rows in (entities.bars(spark, SMALL), entities.placed_bars(spark, SMALL)):
        assert "SortAggregate" not in plan(rows) and plan(rows).count("Exchange ") == 1
    assert plan(prices.with_indicators(entities.bars(spark, SMALL))).count("Exchange ") == 1
    assert plan(QUERIES["latest_signals"](spark, SMALL)).count("Exchange ") == 1


def test_bars_of_events_are_marked(spark):
    bars = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", None), (2, "2024-01-01", 7.0)], "code long, date string, close double")
    events = spark.createDataFrame([(9, 1, "2024-01-02"), (8, 1, "2024-01-02"), (7, 2, "2024-01-05"), (6, None, "2024-01-01")], "id long, code long, date string")
    got = {(r.code, r.date): (r.close, r.asked) for r in training.marked(bars, events).collect()}
    assert got == {(1, "2024-01-01"): (5.0, False), (1, "2024-01-02"): (None, True), (2, "2024-01-01"): (7.0, False)}


def test_macd_of_some_bars_counts_all(spark):
    bars = entities.bars(spark, SMALL).select("code", "date", "close").withColumn("odd", F.dayofmonth("date") % 2 == 1)
    every, some = recurrences.with_macd(bars), recurrences.with_macd(bars, shown="odd")
    assert sorted(map(tuple, every.where("odd").collect())) == sorted(map(tuple, some.collect()))
