"""Lists, cursors, models and scraped pages on small fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import fundamentals, training
from tidemark.sources import pages, store

RECORD = T.StructType([T.StructField("code", T.StringType()), T.StructField("title", T.StringType()), T.StructField("day", T.StringType())])


def test_lists_are_read_rewritten_and_deleted(spark, tmp_path):
    path = f"{tmp_path}/lists/2024-05-01"
    assert store.read_list(spark, path, RECORD).collect() == [] and not store.delete(spark, path)
    rows = spark.createDataFrame([("1", "あ", None), ("2", None, "2024-05-01")], RECORD)
    store.rewrite_list(rows, path)
    store.rewrite_list(store.read_list(spark, path, RECORD).where("code = '2'").unionByName(rows.where("code = '1'").withColumn("code", F.lit("3"))), path)
    assert sorted(map(tuple, store.read_list(spark, path, RECORD).collect()), key=str) == [("2", None, "2024-05-01"), ("3", "あ", None)]
    (tmp_path / "old.json").write_text('[{"code": "7", "title": "x", "more": 1}, {"code": null}]')
    assert sorted(map(tuple, store.read_list(spark, f"{tmp_path}/old.json", RECORD).collect()), key=str) == [("7", "x", None), (None, None, None)]
    assert store.delete(spark, path) and store.read_list(spark, path, RECORD).count() == 0


def test_errors_are_written_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "2024-05-01"), ("2", "b", "2024-05-02"), ("3", "c", None)], RECORD).withColumn("day", F.to_date("day"))
    assert store.write_errors(rows, f"{tmp_path}/new", "day") == ["2024-05-01", "2024-05-02"]
    store.write_errors(rows.where("code = '1'").withColumn("title", F.lit("z")), f"{tmp_path}/new", "day")
    assert [r.title for r in store.read_list(spark, f"{tmp_path}/new/2024-05-01_error", RECORD).collect()] == ["z"]
    assert [r.title for r in store.read_list(spark, f"{tmp_path}/new/2024-05-02_error", RECORD).collect()] == ["b"]


def test_csv_lists(spark, tmp_path):
    (tmp_path / "growth.csv").write_text('日付,終値,始値,高値,安値,出来高,変化率\n2024/5/1,"1,001.5",990,1010,980,"12,000",0.1%\n2024-05-02,-,1,2,3,4,x\nx,1,1,1,1,1,1\n')
    got = [(str(r.date), r.open, r.close, r.volume) for r in store.growth_index(spark, f"{tmp_path}/growth.csv").orderBy("date").collect()]
    assert got == [("2024-05-01", 990.0, 1001.5, 12000.0), ("2024-05-02", 1.0, None, 4.0)]
    (tmp_path / "words.csv").write_text("株主総会\n 辞任 \n\n株主総会\n")
    assert store.keywords(spark, f"{tmp_path}/words.csv") == ["株主総会", "辞任"]
    (tmp_path / "companies.csv").write_text("日付,コード,銘柄名,市場,a,b,c,d,e,f\n20240501,1301,株式会社 極洋,P,1,2,3,4,5,6\n20240501,130A,ABC・HD,G\n20240501,,名無し,G,1,2,3,4,5,6\n20240501,1301,株式会社 極洋,P,1,2,3,4,5,6\n")
    assert sorted(map(tuple, store.companies(spark, f"{tmp_path}/companies.csv").collect())) == [("1301", "極洋"), ("130A", "ＡＢＣ")]
    (tmp_path / "fin.csv").write_text(",".join(store.STATEMENT_COLUMNS) + "\n1301,2024/03,100,,50,1,2,3,-,40,5,6,7,8,-,9,10\n")
    fin = store.read_csv(spark, f"{tmp_path}/fin.csv", store.STATEMENT_COLUMNS)
    r = fundamentals.typed(fin).first()
    assert (r.code, str(r.fiscal_end), r.assets, r.equity, r.bps, r.eps, r.roa) == ("1301", "2024-03-31", 100.0, 50.0, None, None, 10.0)
    assert store.guarded(fin, ["code", "roa"]).count() == 1 and store.guarded(fin, ["code", "nothing"]).count() == 0
    assert store.guarded(fin, ["code", "nothing"]).columns == ["code", "nothing"]


STEPS = ("write_bytes", "_renamed", "delete")


def stopped_at(monkeypatch, n):
    """From now on the n-th of the store's steps raises instead of being made."""
    left = [n]

    def guard(f):
        def run(*args):
            left[0] -= 1
            if left[0] < 0:
                raise KeyboardInterrupt
            return f(*args)

        return run

    for name in STEPS:
        monkeypatch.setattr(store, name, guard(getattr(store, name)))


def every_stop(write, read, old, new):
    """write() stopped before each of its steps in turn: read() finds the old content or the new; both are met with."""
    found = []
    for n in range(40):
        with pytest.MonkeyPatch.context() as patched:
            stopped_at(patched, n)
            try:
                write()
                done = True
            except KeyboardInterrupt:
                done = False
        found.append(read())
        assert found[-1] in (old, new)
        if done:
            assert found[-1] == new
            return len(found)
        if found[-1] == new:
            old = new  # the commit is made: what follows is tidying
    raise AssertionError("it never ended")


def test_a_list_is_old_or_new_at_every_stop(spark, tmp_path):
    path = f"{tmp_path}/list"
    rows = lambda c: spark.createDataFrame([(c, "t", None)], RECORD)
    read = lambda: [r.code for r in store.read_list(spark, path, RECORD).collect()]
    assert every_stop(lambda: store.rewrite_list(rows("1"), path), read, [], ["1"]) >= 3
    assert every_stop(lambda: store.rewrite_list(rows("2"), path), read, ["1"], ["2"]) >= 3
    for k in "3456":
        store.rewrite_list(rows(k), path)
    assert read() == ["6"] and sum(n.startswith("v-") for n in os.listdir(path)) == 2  # the last and the one before


def test_cursor_and_model_are_old_or_new_at_every_stop(spark, tmp_path):
    cursor = store.Cursor(spark, f"{tmp_path}/cursor")
    place = lambda: (cursor.value(), cursor.backup())
    assert every_stop(lambda: cursor.advance("a"), place, (None, None), ("a", None)) >= 3
    cursor = store.Cursor(spark, f"{tmp_path}/second")
    cursor.advance("x")
    cursor.advance("a")
    with pytest.MonkeyPatch.context() as patched:
        stopped_at(patched, 1)  # the commit's content is written, its name isn't there yet
        with pytest.raises(KeyboardInterrupt):
            cursor.advance("b")
    assert place() == ("a", "x")
    cursor.advance("b")
    assert place() == ("b", "a") and len(store.commits(spark, cursor.path)) == 2
    path = f"{tmp_path}/weights"
    read = lambda: None if (w := store.load_model(spark, path)) is None else w["a"].tolist()
    assert every_stop(lambda: store.save_model(spark, {"a": np.ones(2)}, path), read, None, [1, 1]) >= 4
    assert every_stop(lambda: store.save_model(spark, {"a": np.zeros(1)}, path), read, [1, 1], [0]) >= 4


def test_days_change_together_or_not_at_all(spark, tmp_path):
    path, schema = f"{tmp_path}/days", "code string, date_key string"
    rows = lambda c, *days: spark.createDataFrame([(c, d) for d in days], schema)
    read = lambda: sorted(tuple(r) for r in store.read_days(spark, path, rows("").schema).collect())
    store.replace_days(rows("old", "2024-01-01", "2024-01-02", "2024-01-03"), path)
    before, after = read(), [("new", "2024-01-01"), ("new", "2024-01-02"), ("old", "2024-01-03")]
    assert every_stop(lambda: store.replace_days(rows("new", "2024-01-01", "2024-01-02"), path), read, before, after) >= 5


def test_cursor_moves_only_after_success(spark, tmp_path):
    cursor = store.Cursor(spark, f"{tmp_path}/state/next")
    assert cursor.value() is None and cursor.step(lambda c: "a") == "a" and cursor.backup() is None
    assert cursor.step(lambda c: c + "b") == "ab" and (cursor.value(), cursor.backup()) == ("ab", "a")

    def fails(_):
        raise ValueError

    with pytest.raises(ValueError):
        cursor.step(fails)
    assert (cursor.value(), cursor.backup()) == ("ab", "a") and cursor.step(lambda c: None) is None and cursor.value() == "ab"


def test_models_are_saved_and_loaded(spark, tmp_path):
    w = {"a": np.arange(6.0).reshape(2, 3), "b": np.zeros(0)}
    store.save_model(spark, w, f"{tmp_path}/model")
    store.save_model(spark, w | {"b": np.ones(2)}, f"{tmp_path}/model")
    got = store.load_model(spark, f"{tmp_path}/model")
    assert got.keys() == w.keys() and (got["a"] == w["a"]).all() and got["b"].tolist() == [1, 1]
    (tmp_path / "broken").write_bytes(b"nothing")
    assert store.load_model(spark, f"{tmp_path}/none") is None and store.load_model(spark, f"{tmp_path}/broken") is None


def test_detail_pages(spark):
    page = '<dl id="info"><dt>【日時】</dt><dd> 2024年5月1日 9時05分 </dd><dt class=m>【資料】</dt><dd><a class=p href="/a.pdf">x</a></dd></dl>'
    rows = [page, page.replace("5月1日", "13月1日"), page.replace('id="info"', ""), None]
    df = spark.createDataFrame(list(enumerate(rows)), "k long, html string")
    stamp, url = pages.detail(F.col("html"))
    got = [tuple(r) for r in df.orderBy("k").select(stamp, url).collect()]
    assert got == [("2024-05-01 09:05:00", "/a.pdf"), (None, "/a.pdf"), (None, None), (None, None)]


def test_quote_pages(spark):
    row = "<tr><th>2024年5月{d}日</th>" + "".join(f"<td><span>{x}</span></td>" for x in ("1,000", "1,010.5", "990", "---", "12,300")) + "</tr>"
    split = "<tr><th>2024年5月9日</th><td colspan=5>分割: 1株 -> 2株</td></tr>"
    rows = [("1", 1, row.format(d=2) + split), ("1", 2, row.format(d=1)), ("1", 3, split), ("1", 4, row.format(d=7)), ("2", 1, None), ("3", 20, row.format(d=3))]
    got = pages.quotes(spark.createDataFrame(rows, "code string, page int, html string")).orderBy("code", "date").collect()
    assert [(r.code, str(r.date), r.open, r.high, r.close, r.volume, r.dividends, r.splits) for r in got] == [("1", f"2024-05-0{d}", 1000.0, 1010.5, None, 12300.0, 0.0, 0.0) for d in (1, 2)]


def test_vectors_have_a_fixed_order(spark):
    record = {"roe": F.lit(2), "eps": F.lit(None).cast("double"), "adx14": F.lit(7.5)}
    v = training.vector(record, training.FEATURES)
    r = spark.range(1).select(v.alias("v"), training.named(v, training.FEATURES).alias("m")).first()
    assert len(r.v) == 17 and r.v[:2] == [0.0, 2.0] and r.v[16] == 7.5 and set(r.m) == set(training.FEATURES) and r.m["adx14"] == 7.5
    assert len(training.TARGETS) == 9


def test_statement_ratios(spark):
    rows = [("a", 100.0, "4", "", "50", "12", ""), ("b", 100.0, "0", "x", "50", "12", "2"), ("c", 100.0, None, None, "50", None, "2"), ("d", 100.0, "5", "", "50", "2", "2")]
    df = spark.createDataFrame(rows, "k string, price double, eps string, bps string, equity string, total_shares string, treasury_shares string")
    got = {r.k: (r.eps, r.bps, r.per, r.pbr, r.cap) for r in fundamentals.statement_ratios(df).collect()}
    assert math.isclose(got["a"][1], 50 / 12) and got["a"][0] == 4 and got["a"][2] == 25 and got["a"][4] == 1200
    assert got["b"] == (0.0, None, None, None, 1000.0) and got["c"] == (None, None, None, None, None) and got["d"] == (5.0, None, 20.0, None, 0.0)
