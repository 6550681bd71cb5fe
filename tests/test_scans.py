"""Global pages, the n-gram index and recurrences against plain Python and pandas."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import paging, recurrences, substrings
from tidemark.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_numbers_are_those_of_the_sorted_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, "a", "a", "b", "é"]), k, rng.random()) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, id long, x double").repartition(5)
    got = {r.id: r.number for r in paging.numbered(df, ["name", F.desc("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))
    assert got == {r[1]: k for k, r in enumerate(want)}
    some = paging.slice_rows(df, ["name", F.desc("id")], 3, 10)
    assert sorted(r.id for r in some.collect()) == sorted(r[1] for r in want[3:13])
    assert "Window" not in plan_of(some) and "SinglePartition" not in plan_of(some)


def test_pages_until_the_first_without_kept_rows(spark):
    rows = [(k, k % 4 != 0 and not 40 <= k < 45) for k in range(100)]
    paged = paging.pages(spark.createDataFrame(rows, "id long, good boolean").repartition(7), ["id"], 5)
    got = paging.until_empty(paged, F.col("good")).collect()
    assert sorted((r.id, r.page) for r in got) == [(k, k // 5) for k, good in rows if good and k < 40]
    assert paging.until_empty(paged, F.col("id") >= 0).count() == 100
    assert paging.until_empty(paged, F.lit(False)).count() == 0


def test_index_finds_the_first_name(spark):
    rng = random.Random(4)
    names = [(k, rng.choice([None, "", "ab", "é東"]) if k % 9 == 0 else "".join(rng.choices("abcé東", k=rng.randint(1, 12)))) for k in range(400)]
    needles = ["", None, "zz", "zzzz", "abcabcabcabcabc"] + ["".join(rng.choices("abcé東", k=rng.randint(1, 6))) for _ in range(300)]
    found = substrings.first_holding(spark.createDataFrame(names, "code long, name string"), spark.createDataFrame([(x,) for x in needles], "needle string"), "name", "needle", "code")
    want = {}
    for x in {x for x in needles if x is not None}:
        for code, name in names:
            if name is not None and x in name:
                want[x] = (code, name)
                break
    assert {r.needle: (r.code, r.name) for r in found.collect()} == want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    nothing = spark.createDataFrame([], "code long, name string")
    assert substrings.first_holding(nothing, spark.createDataFrame([("a",), ("abcd",)], "needle string"), "name", "needle", "code").count() == 0


def test_index_of_many_names(spark):
    """100,000 names and 20,000 needles: candidates are of the order of the matches, not of the product."""
    names = spark.range(100_000).select(F.col("id").alias("code"), F.sha1(F.col("id").cast("string")).alias("name"))
    needles = spark.range(0, 100_000, 5).select(F.substring(F.sha1(F.col("id").cast("string")), 9, 12).alias("needle"))
    found = substrings.first_holding(names, needles, "name", "needle", "code").select("needle", "code").collect()
    assert len(found) == 20_000 and {r.code for r in found} == set(range(0, 100_000, 5))


def series(seed, lengths):
    rng, day = random.Random(seed), datetime.date(1999, 12, 1)
    out = []
    for code, n in enumerate(lengths):
        at = day + datetime.timedelta(rng.randint(0, 400))
        for _ in range(n):
            out.append((code, at, float(rng.randint(1, 100_000))))
            at += datetime.timedelta(rng.choice([1, 1, 1, 3, 400 if rng.random() < 0.02 else 1]))
    return out


@pytest.mark.parametrize("piece", [256, 3, 1])
def test_means_equal_pandas(spark, monkeypatch, piece):
    monkeypatch.setattr(recurrences, "PIECE", piece)
    rows = series(piece, [1, 2, 13, 40, 900])
    bars = spark.createDataFrame(rows, "code long, date date, close double").repartition(4)
    frame = pd.DataFrame(rows, columns=["code", "date", "close"])
    got = recurrences.with_macd(bars).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    means = recurrences.with_means(bars, "close", {"m2": 2, "m50": 50}).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
    for code, d in frame.groupby("code"):
        macd = mean(d["close"], 12) - mean(d["close"], 26)
        own = got[got["code"] == code]
        assert own["macd"].tolist() == pytest.approx(macd.tolist(), rel=1e-9, abs=1e-7)
        assert own["signal"].tolist() == pytest.approx(mean(macd, 9).tolist(), rel=1e-9, abs=1e-7)
        for n in (2, 50):
            assert means[means["code"] == code][f"m{n}"].tolist() == pytest.approx(mean(d["close"], n).tolist(), rel=1e-9)


def test_macd_has_no_python(spark):
    bars = spark.createDataFrame(series(1, [5]), "code long, date date, close double")
    assert not any(word in plan_of(recurrences.with_macd(bars)) for word in ("Pandas", "Python", "Arrow"))
    assert recurrences.with_macd(bars.limit(0)).count() == 0
    with pytest.raises(ValueError, match="span"):
        recurrences.with_means(bars, "close", {"m": 1})


def test_no_side_of_a_lookup_is_broadcast(spark):
    """Sizes are estimated from compressed files: sides that pass for small are sorted and merged all the same, in any plan that Spark turns to."""
    found = QUERIES["name_index_lookup"](spark, "/root/testdata/sf0.001")
    assert found.count() == found.select("part").distinct().count()
    found.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_and_null_orders(spark):
    names = spark.createDataFrame([(2, "xab"), (1, "yabc"), (1, "zabc"), (None, "qqabcdefghijk"), (3, "abcdefghijk")], "code long, name string")
    found = substrings.first_holding(names, spark.createDataFrame([("ab",), ("abc",), ("x",), ("abcdefghij",), ("zzzzzzzzzzzz",), (None,), ("",)], "needle string"), "name", "needle", "code")
    assert {tuple(r) for r in found.collect()} == {("ab", None, "qqabcdefghijk"), ("abc", None, "qqabcdefghijk"), ("x", 2, "xab"), ("abcdefghij", None, "qqabcdefghijk"), ("", None, "qqabcdefghijk")}
