"""Chained and numbered pages as a data source: batches, streams, stops and later pages."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.sources import chain, pages

LIST = """<table class="x cs y"><tr><th>d</th></tr><tr><td>2024/05/01</td><td class="ct"><a href="/1301">1301</a></td><td class="wmx300"><a href="/n">名 &amp; 前</a></td><td><a href='/d/{k}'> 題 </a></td></tr>
<tr><td>short</td></tr></table><table><tr><td>1</td><td>2</td><td>3</td></tr></table><table><tr id="loading" data-nx="/td?y={n}&amp;p=1&pg=true"></tr></table>"""
END = "<p>gone</p>"


def linked(path, n, ends=True):
    """A chain of n pages from td?y=0; without an end the last names a page that isn't there yet."""
    folder, cursors = chain.Folder(str(path)), [f"td?y={k}&p=1" if k else "td?y=0" for k in range(n)]
    for k, cursor in enumerate(cursors):
        folder.put(cursor, END if ends and k == n - 1 else LIST.format(k=k, n=k + 1))
    return cursors


def test_linked_pages_are_followed(spark, tmp_path):
    cursors = linked(tmp_path, 3)
    found = chain.read_chain(spark, str(tmp_path), start="td?y=0").orderBy("page").collect()
    assert [(r.page, r.cursor, r.next) for r in found] == [(1, cursors[0], cursors[1]), (2, cursors[1], cursors[2]), (3, cursors[2], None)]
    rows = spark.createDataFrame(found).select(F.explode(pages.list_rows(F.col("html"))).alias("r")).collect()
    assert [r.r for r in rows] == [["2024/05/01", "1301", "名 & 前", f"題=>/d/{k}"] for k in (0, 1)]
    assert chain.read_chain(spark, str(tmp_path), start="td?y=0", most="2").count() == 2
    assert chain.read_chain(spark, str(tmp_path), start="none").count() == 0 == chain.read_chain(spark, f"{tmp_path}/nothing", start="td?y=0").count()


def test_dead_ends_lead_on(spark, tmp_path):
    folder = chain.Folder(str(tmp_path))
    folder.put("a", LIST.format(k=0, n="dead"))
    folder.put("b", END)
    found = chain.read_chain(spark, str(tmp_path), start="a", dead_ends=json.dumps({"td?y=dead&p=1": "b"})).orderBy("page").collect()
    assert [r.cursor for r in found] == ["a", "b"]


@pytest.mark.parametrize("n", [0, 1, 150])
def test_numbered_pages_are_dealt_to_tasks(spark, tmp_path, n):
    folder = chain.Folder(str(tmp_path))
    for k in [*range(1, n + 1), n + 2]:
        folder.put(str(k), f"page {k}")
    found = chain.read_chain(spark, str(tmp_path), kind="numbered")
    assert sorted((r.page, r.cursor, r.html) for r in found.collect()) == [(k, str(k), f"page {k}") for k in range(1, n + 1)]
    assert found.rdd.getNumPartitions() == max(1, -(-n // chain.PAGES_A_TASK)) or n == 0
    assert chain.read_chain(spark, str(tmp_path), kind="numbered", most="70").count() == min(n, 70)


def run(spark, path, at, store, **options):
    """One look after another until nothing is left, each by `store`."""
    query = chain.stream_chain(spark, str(path), **options).writeStream.foreachBatch(store).option("checkpointLocation", f"{at}/offsets").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_equals_batch_and_goes_on_with_later_pages(spark, tmp_path):
    source, table, batches = tmp_path / "pages", str(tmp_path / "table"), []

    def store(batch, k):
        batches.append(k)
        batch.write.mode("overwrite").parquet(f"{table}/batch={k}")

    read = lambda: sorted((r.page, r.cursor, r.html, r.next) for r in spark.read.parquet(table).select("page", "cursor", "html", "next").collect())
    linked(source, 5, ends=False)
    run(spark, source, tmp_path, store, start="td?y=0", most="2")
    batch = lambda: sorted(map(tuple, chain.read_chain(spark, str(source), start="td?y=0").collect()))
    assert read() == batch() and len(read()) == 5 and len(batches) >= 3
    linked(source, 9)  # pages that the last one named come into being
    run(spark, source, tmp_path, store, start="td?y=0", most="2")
    assert read() == batch() and len(read()) == 9


@pytest.mark.parametrize("fails", [0, 1, 2])
def test_no_page_is_lost_or_doubled_by_a_stop(spark, tmp_path, fails):
    """The sink breaks off in the middle of a batch: the next run is given the same pages under the same number."""
    source, seen = tmp_path / "pages", {}
    cursors = linked(source, 6)

    def broken(batch, k):
        rows = [r.cursor for r in batch.collect()]
        if k == fails:
            seen["lost"] = rows
            raise ValueError("the sink is gone")
        seen[k] = rows

    with pytest.raises(StreamingQueryException):
        run(spark, source, tmp_path, broken, start="td?y=0", most="2")
    run(spark, source, tmp_path, lambda batch, k: seen.__setitem__(k, [r.cursor for r in batch.collect()]), start="td?y=0", most="2")
    assert seen[fails] == seen.pop("lost")
    assert sum((seen[k] for k in sorted(seen)), []) == cursors
