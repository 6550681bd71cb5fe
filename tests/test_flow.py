"""Text chain, relational operators, streams and the regressor on small fixtures."""

import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import regressor
from tidemark.operators import relational as R
from tidemark.sources import pages, store
from tidemark.streaming import ingest


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (C.narrowed, "ＡＢ１２ア", "AB12ア"),
        (C.without_invisible, "a\u200bb\ufe0f", "ab"),
        (C.without_header, "序文 業績について本文", "本文"),
        (C.without_header, "x" * 301 + "について本文", "x" * 301 + "について本文"),
        (C.without_header, "TEL 03-1234-5678 本文", " 本文"),
        (C.without_footer, "本文 以 上 連絡先", "本文 "),
        (C.without_footer, "以上" + "x" * 201, "以上" + "x" * 201),
        (C.split_years, "年 20202021202220 x", "年  <YEAR> <YEAR> <YEAR>20 x"),
        (C.split_years, "推移202020212022", "推移 <YEAR> <YEAR> <YEAR>"),
        (C.joined_units, "売上 10 億円と3株主と5 株", "売上 10_億円と3株主と5_株"),
        (C.signed_numbers, "△5 ＋7 ▲8", "-5 +7 -8"),
        (C.extended_tags, "<YEAR>末日 <FISCAL>1Q <DATE>1q", "<YEAR_EXT> <FISCAL_QUARTER1_EXT> <DATE_DEFAULT>"),
        (C.cleaned, "２０２４年３月期 売上 10 億円 a@b.co.jp https://x.jp/y", "<FISCAL> 売上 10_億円 <MAIL> <URL>"),
        (C.cleaned, "令和6年4月1日（月）に発表", "<DATE>に発表"),
        (C.cleaned, "電話 03-1234-5678 まで", "まで"),
        (C.company, "株式会社ABC・1 HD", "ＡＢＣ１"),
        (C.short_code, "13300", "133"),
        (C.short_code, "1330", "1330"),
        (C.cell, "a\nb （3）", "（3） a b"),
        (C.cell, "", "*"),
        (C.escaped, "<a href='x'>&", "&lt;a href=&#039;x&#039;&gt;&amp;"),
        (C.broken, "日本語", False),
        (C.broken, "日本\n語", True),
        (C.broken, "abc", True),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f, text) == want


def test_upsert_keeps_first_place_and_last_value(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, seq int, v string")
    new = spark.createDataFrame([("b", 1, "new"), ("c", 2, "new"), ("b", 3, "newer")], "k string, seq int, v string")
    got = [(r.k, r.v) for r in R.upsert(stored, new, ["k"], "seq").orderBy("place_side", "place").collect()]
    assert got == [("a", "old"), ("b", "newer"), ("c", "new")]


def test_new_rows_treats_nulls_as_equal(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "k string, t string")
    assert R.new_rows(rows, rows.where("k = 'a'"), ["k", "t"]).collect() == [("b", "x")]


def test_pages(spark):
    html = "<table><tr><td>a</td><td><a href='/x'>b</a></td></tr><tr></tr></table>"
    assert one(spark, pages.cells, html) == [["a", "b:/x"]]
    feed = 'addReleaseList({"articles":[{"title":" T ","text":"x","provider":{"name":"N"},"updated_at":{"time_iso_8601":"2024-05-01T09:30:00+09:00"}}]});'
    got = one(spark, pages.articles, feed)
    assert [tuple(a) for a in got] == [("09:30", "N", "T", "x")]


def test_stream_adds_each_key_once_and_alerts_on_new_rows(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    write = lambda rows: spark.createDataFrame(rows, "code string, title string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.ingest(
        spark.readStream.schema("code string, title string").parquet(source), str(tmp_path / "table"), ["code", "title"], str(tmp_path / "offsets"), lambda d: seen.extend(r.title for r in d.collect()), "title", ["増配"]
    ).awaitTermination()
    write([("1", "増配"), ("1", "増配"), ("2", "x")])
    run()
    write([("1", "増配"), ("3", "増配 two")])
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect()))
    assert got == [("1", "増配"), ("2", "x"), ("3", "増配 two")] and seen == ["増配", "増配 two"]


def test_stream_by_day_reads_its_days_alone(spark, tmp_path):
    source, table, schema = str(tmp_path / "in"), str(tmp_path / "table"), "code string, title string, day date"
    rows = lambda *r: spark.createDataFrame([(c, t, None if d is None else date(2024, 1, d)) for c, t, d in r], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda alert=None: ingest.ingest(spark.readStream.schema(schema).parquet(source), table, ["day", "code", "title"], str(tmp_path / "offsets"), alert, "title", ["a"], day="day").awaitTermination()
    rows(("1", "a", 1), ("1", "a", 1), ("2", "b", 2), ("3", "c", None))
    run()
    rows(("1", "a", 1), ("1", "a", 2), ("3", "c", None))

    def fails(new):
        raise ValueError("no alert today")

    with pytest.raises(StreamingQueryException):
        run(fails)
    seen = []
    run(lambda new: seen.extend(r.day.day for r in new.collect()))  # the failed batch again: its rows are in the table
    got = sorted((r.code, r.title, r.day and r.day.day or 0) for r in spark.read.parquet(table).collect())
    assert got == [("1", "a", 1), ("1", "a", 2), ("2", "b", 2), ("3", "c", 0)] and seen == []
    assert sorted(os.listdir(tmp_path)) == ["in", "offsets", "table"]


EVENT = "code string, title string, at timestamp"


def test_keys_are_remembered_for_a_time(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    write = lambda *rows: spark.createDataFrame([(c, t, datetime(2024, 1, 1) + timedelta(hours=h)) for c, t, h in rows], EVENT).coalesce(1).write.mode("append").parquet(source)

    def run():
        q = ingest.ingest_once(spark.readStream.schema(EVENT).parquet(source), table, ["code", "title"], "at", str(tmp_path / "offsets"), keep="2 hours")
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    def read():
        return sorted((r.code, r.at.day, r.at.hour) for r in spark.read.parquet(table).collect())

    write(("1", "a", 0), ("1", "a", 1), ("2", "b", 1))
    run()
    assert read() == [("1", 1, 0), ("2", 1, 1)]
    write(("1", "a", 1), ("3", "c", 2))  # a repeat, in another run
    full = run()
    assert read() == [("1", 1, 0), ("2", 1, 1), ("3", 1, 2)]
    write(("9", "z", 60))  # the watermark passes all keys before
    assert run()[-1] == 1 < max(full)
    write(("1", "a", 61))
    run()
    assert read() == [("1", 1, 0), ("1", 3, 13), ("2", 1, 1), ("3", 1, 2), ("9", 3, 12)]
    plan = ingest.first_per_key(spark.readStream.schema(EVENT).parquet(source), ["code"], "at")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan


def test_alerts_outlast_a_sink_that_fails(spark, tmp_path):
    source, table, taken, broken = str(tmp_path / "in"), str(tmp_path / "table"), [], [2, 5]
    rows = [(str(k), "増配" if k % 2 else "x", datetime(2024, 1, 1, k)) for k in range(12)] + [("1", "増配", datetime(2024, 1, 1, 13))]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(source)
    ingest.ingest_once(spark.readStream.schema(EVENT).parquet(source), table, ["code"], "at", str(tmp_path / "offsets")).awaitTermination()

    def sink(record):
        if broken and len(taken) == broken[0]:
            broken.pop(0)
            raise ConnectionError("the sink is away")
        taken.append(record["code"])

    run = lambda: ingest.deliver(spark.readStream.schema(EVENT).parquet(table), ["code"], "title", ["増配"], sink, str(tmp_path / "marks"), str(tmp_path / "sent")).awaitTermination()
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    run()  # nothing is left
    assert sorted(taken, key=int) == ["1", "3", "5", "7", "9", "11"] and not broken
    spark.createDataFrame([("21", "増配", datetime(2024, 1, 1, 20)), ("3", "増配", datetime(2024, 1, 1, 20))], EVENT).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_once(spark.readStream.schema(EVENT).parquet(source), table, ["code"], "at", str(tmp_path / "offsets")).awaitTermination()
    run()
    assert taken[6:] == ["21"]


def test_days_are_replaced_or_merged(spark, tmp_path):
    path = str(tmp_path / "days")
    frame = lambda rows: spark.createDataFrame(rows, "code string, title string, seq int, day string").withColumn("day", F.to_date("day"))
    read = lambda days=None: sorted((r.code, r.seq) for r in store.read_days(spark, path, frame([]).schema, days).collect())
    assert read() == []
    ingest.store_days(frame([("1", "a", 1, "2024-01-01"), ("2", "b", 2, "2024-01-02"), ("9", "z", 9, None)]), path, "day", ["code", "title"], "seq", today=True)
    before = store.read_days(spark, path, frame([]).schema)
    ingest.store_days(frame([("1", "a", 5, "2024-01-01"), ("3", "c", 6, "2024-01-01")]), path, "day", ["code", "title"], "seq", today=False)
    assert read() == [("1", 5), ("2", 2), ("3", 6)] and read(["2024-01-02"]) == [("2", 2)]
    assert sorted(r.seq for r in before.collect()) == [1, 2]  # whoever read the version before isn't disturbed
    ingest.store_days(frame([("7", "q", 7, "2024-01-02")]), path, "day", ["code", "title"], "seq", today=True)
    assert read() == [("1", 5), ("3", 6), ("7", 7)]
    assert {r.date_key for r in store.read_days(spark, path, frame([]).schema).collect()} == {"2024-01-01", "2024-01-02"}


def test_regressor_learns_and_its_gradient_is_right(spark):
    rng = np.random.default_rng(1)
    w = regressor.start(6, 4, 2)
    text, features, targets = rng.normal(size=(5, 6)), rng.normal(size=(5, 4)), rng.normal(size=(5, 2))
    _, g = regressor.gradients(w, text, features, targets)
    for name in w:
        at = tuple(0 for _ in w[name].shape)
        up = {k: v.copy() for k, v in w.items()}
        up[name][at] += 1e-6
        slope = (regressor.gradients(up, text, features, targets)[0] - regressor.gradients(w, text, features, targets)[0]) / 1e-6
        assert slope == pytest.approx(g[name][at], abs=1e-4)
    rows = spark.createDataFrame([(k, rng.normal(size=6).tolist(), rng.normal(size=4).tolist(), [float(k % 3), 1.0]) for k in range(64)], "id long, text_vector array<double>, features array<double>, targets array<double>")
    weights, losses = regressor.fit(rows, epochs=30)
    assert losses[-1] < losses[0]
    got = {r.id: r.rates for r in regressor.predict(rows, weights, ("near", "far")).collect()}
    r = rows.first()
    assert np.allclose([got[r.id]["near"], got[r.id]["far"]], regressor.forward(weights, np.array([r.text_vector]), np.array([r.features]))[0][0])


def test_first_seen_deals_its_deliveries_to_tasks(spark, tmp_path, monkeypatch):
    """No delivery is gathered in one task's file, and each is a batch of its own."""
    from tidemark.plans import learning

    at = spark.createDataFrame([(k % 40, "ab"[k % 2], k) for k in range(4000)], "user_id long, event_type string, n long").selectExpr("user_id", "event_type", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, n % 977) AS ts")
    at.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(learning, "shared_dir", lambda s, label: f"{tmp_path}/out-{label}")
    gathered = []
    coalesce = type(at).coalesce
    monkeypatch.setattr(type(at), "coalesce", lambda self, n: gathered.append(n) or coalesce(self, n))
    got = {tuple(r) for r in learning.stream_first_seen(spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in at.groupBy("user_id", "event_type").agg(F.min("ts")).collect()} and len(got) == 40
    assert not gathered and len(list((tmp_path / "out-stream" / "offsets" / "commits").glob("[0-9]*"))) >= 2
