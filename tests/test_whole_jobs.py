"""Queries whose registered SQL is narrower than the job: held against the whole job here."""

import re

import duckdb

from tidemark.operators import regressor
from tidemark.plans.market import BARS, DISC, INDEX
from tidemark.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def same(spark, name, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, want = QUERIES[name](spark, SMALL), con.sql(sql)
    assert sorted(found.columns) == sorted(want.columns)
    rows = sorted(map(tuple, found.select(*want.columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    return rows


def test_every_order_is_looked_up(spark):
    rows = same(spark, "text_lookup_left", "SELECT o_orderkey AS id, coalesce(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), '') AS text FROM orders LEFT JOIN documents ON doc_id = o_orderkey", "orders", "documents")
    assert len(rows) == 1500 and any(i % 3 for i, _ in rows)


def test_urls_are_masked_in_every_text(spark, tmp_path):
    """Against Python's re, whose classes of letters are Unicode's."""
    texts = ["plain", None, "", "siehe https://x.de/ä?q=é#ü für mehr", "HTTPS://X.JP/東京。次 www.é.fr", "naïve café, no link", "http://a.b/c|http://d", "wwwx www. www.é", "\U0001f600https://x/\U0001f600"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    url = re.compile(r"(?i)(?:https?://|www\.)[\w\-._~:/?#\[\]@!$&'()*+,;=%]+")
    got = {r.doc_id: r.text for r in QUERIES["url_mask"](spark, str(tmp_path)).collect()}
    assert got == {k: t if t is None else url.sub("<URL>", t) for k, t in enumerate(texts)}
    assert QUERIES["url_mask"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_all_codes_are_flattened(spark):
    assert {r[0] for r in same(spark, "json_flatten", f"WITH {BARS} SELECT code, date, close::BIGINT AS close FROM bars", "lineitem")} == set(range(10))


def test_next_day_of_all_bars(spark):
    same(spark, "next_available_day", f"WITH {BARS}, x AS (SELECT DISTINCT date AS day FROM bars) SELECT a.day, min(b.day) AS next_day FROM x a JOIN x b ON b.day > a.day AND b.day <= a.day + 10 GROUP BY a.day", "lineitem")


def test_index_days_of_every_code(spark):
    rows = same(spark, "day_offset_semi", f"WITH {BARS}, {INDEX}, c AS (SELECT DISTINCT code FROM bars) SELECT code, idx.date, close FROM c, idx WHERE (code, idx.date) IN (SELECT (code, date) FROM bars)", "lineitem")
    assert {r[0] for r in rows} == set(range(10))


def test_distances_up_to_200_days(spark):
    rows = same(spark, "day_distance", f"WITH {BARS}, {DISC} SELECT id, date_diff('day', disc.date, b.date) AS days FROM disc JOIN bars b ON b.code = disc.code WHERE date_diff('day', disc.date, b.date) BETWEEN -200 AND 200", "lineitem", "orders", "customer", "supplier")
    assert min(d for _, d in rows) == -200 and max(d for _, d in rows) == 200


def test_fitting_takes_no_prefix(spark, tmp_path):
    """The operator's own sample: by hash of id, the same for any order and partitioning of the rows."""
    rows = [(k, [k / 3000.0] * 64, k % 10) for k in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["mlp_fitted"](spark, str(tmp_path)).count() == 3000
    ids = spark.range(3000)
    got = [r.id for r in regressor.sample(ids, 200).collect()]
    assert len(got) == 200 and max(got) > 2000 and got == [r.id for r in regressor.sample(ids.orderBy("id", ascending=False).repartition(7), 200).collect()]
    assert regressor.sample(ids).count() == 3000
