import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc

LONG = "<p>" + "x" * 200 + "é</p>"
PAGES = [
    (5, "http://a/5", LONG),
    (3, "http://a/3", LONG),
    (9, None, LONG),
    (3, "http://a/3", LONG),
    (None, "http://a/n", LONG),
    (1, "http://a/1", "tiny"),
    (2, "http://a/2", "tiny"),
    (4, "http://a/4\r\nEvil: 1", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9),
    (8, "http://a/8", "long " * 900_000),
    (None, "u", "y" * 100),
    (None, "u", "y" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload_digest string, refers_to int")


def brute():
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        refers = min(ids) if len(data) >= 100 and ids and i != min(ids) else None
        yield i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers


def test_round_trip(pages):
    archives = warc.normalise(warc.write_archives(warc.with_revisits(pages)))
    got = warc.read_records(archives).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(brute(), key=str)
    assert {r.url for r in got if r.page_id == 4} == {"http://a/4%0D%0AEvil: 1"}


@pytest.mark.parametrize("broadcast_rows", [1, 2, 1000])
def test_copies_by_digest_and_by_broadcast(spark, pages, broadcast_rows):
    """With few groups, with one group too many (the largest is sent, the other joined), and the same rows each time."""
    more = pages.unionByName(spark.createDataFrame([(i, "u", "z" * 150, "clash", 1) for i in (21, 20, 22)] + [(i, None, "q" * 101, "clash", 1) for i in (31, 30)], pages.schema))
    got = warc.with_revisits(more, broadcast_rows=broadcast_rows)
    assert set(got.columns) == {"page_id", "url", "payload", "payload_digest", "refers_to"}
    rows = sorted(((r.page_id, len(r.payload), r.refers_to) for r in got.collect()), key=str)
    want = [(i, n, refers) for i, n, _, _, refers in brute()] + [(20, 150, None), (21, 150, 20), (22, 150, 20), (30, 101, None), (31, 101, 30)]
    assert rows == sorted(want, key=str)


def test_members_open_alone_and_in_a_row(pages):
    for row in warc.normalise(warc.write_archives(warc.with_revisits(pages))).collect():
        data = open(row.path.removeprefix("file:"), "rb").read()
        whole = gzip.decompress(data)
        parts = []
        for line in open(row.index_path.removeprefix("file:")):
            _, at, size = line.split("\t")
            parts.append(gzip.decompress(data[int(at) : int(at) + int(size)]))
        assert b"".join(parts) == whole and len(parts) == row.n_records
        assert all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_streams_of_one_or_more_members():
    one = warc.record(1, "http://a", b"abc", "d", None)
    two = warc.record(2, "http://b", b"", "e", 1)
    for data in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two), gzip.compress(b"")):
        found = [d for d, _ in warc.records(warc.inflated(io.BytesIO(data)))]
        assert found in ([one, two], [])
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(one[:-9])))))


def test_no_pages(pages):
    assert warc.read_records(warc.normalise(warc.write_archives(warc.with_revisits(pages.limit(0))))).count() == 0
