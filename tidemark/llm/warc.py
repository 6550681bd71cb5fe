"""Operator 7: WARC archives, from one gzip stream to a member per record.

write_archives() lays records down as crawlers often do, a whole file as one
gzip stream. normalise() inflates each stream once, in bounded pieces,
rewrites every record as a gzip member of its own and writes a sidecar index
of offsets. read_records() goes by the index: it seeks to each member and
inflates that alone. All three run a file per task, name files anew in every
attempt and list them in a stored manifest, so that a lost executor's
leftovers are never read.

Pages with equal payloads of at least MIN_REVISIT bytes: the smallest page_id
is the response and the others revisit it. A null page_id is never referred
to and is a response if its group has no other id; repeated rows of the
smallest id are all responses. Null html is the empty payload; a null url is
left out. An empty table gives no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

MIN_REVISIT = 100
BROADCAST_ROWS = 500_000
PIECE = 1 << 20
LEVEL = 6
GZIP = 31  # window bits that mean a gzip wrapper
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL, GAP = b"\r\n", b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to: the page of which a page is a copy, or null.

    Only digests are grouped. Groups of copies are few and are sent to all
    tasks; if they aren't, those are sent that have so many copies that no more
    than broadcast_rows groups can, and the rest, none of them large, is joined
    by digest. A page of a group that was sent has a key of its own there.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    first = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )
    first = common.stored(first, "warc-copies")
    n, copies = first.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    refers = F.when(F.col("first_id") != F.coalesce(F.col("page_id"), F.col("first_id") + 1), F.col("first_id"))
    if n <= broadcast_rows:
        return base.join(F.broadcast(first.drop("copies")), "payload_digest", "left").withColumn("refers_to", refers).drop("first_id")
    many = copies // broadcast_rows + 1
    sent = first.where(F.col("copies") >= many).select("payload_digest", F.col("first_id").alias("sent_id"), F.lit(True).alias("sent"))
    rest = first.where(F.col("copies") < many).select(F.col("payload_digest").alias("key"), F.col("first_id").alias("rest_id"))
    key = F.when(F.col("sent"), F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest"))
    both = base.join(F.broadcast(sent), "payload_digest", "left").withColumn("key", key).join(rest, "key", "left")
    return both.withColumn("first_id", F.coalesce("sent_id", "rest_id")).withColumn("refers_to", refers).select("page_id", "url", "payload", "payload_digest", "refers_to")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit holds the HTTP header alone, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + GAP + block + GAP


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def id_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def inflated(source) -> Iterator[bytes]:
    """A gzip stream's content piece by piece, each input byte read once; members may follow one another."""
    engine = zlib.decompressobj(GZIP)
    while data := source.read(PIECE):
        while True:
            if out := engine.decompress(data, PIECE):
                yield out
            data = engine.unconsumed_tail
            if not data and len(out) < PIECE and not engine.eof:
                break
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(GZIP)
                if not data:
                    break
    if out := engine.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(whole record, its fields) from a stream of bytes; holds one record and one piece."""
    held, need, named = bytearray(), 0, {}
    for piece in pieces:
        held += piece
        while True:
            if not need and (at := held.find(GAP)) >= 0:
                named = fields(bytes(held[:at]))
                need = at + len(GAP) + int(named["content-length"]) + len(GAP)
            if not need or len(held) < need:
                break
            yield bytes(held[:need]), named
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes each partition of with_revisits() as one gzip stream; the manifest has their paths."""
    folder = common.shared_dir(pages.sparkSession, "warc-streams")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, engine, name = None, zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                system, where = common.open_dir(folder)
                out = system.open_output_stream(f"{where}/{name}", compression=None)
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))
            for row in zip(*columns, strict=True):
                out.write(engine.compress(record(*(v.as_py() for v in row))))
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return common.stored(pages.select("page_id", "url", "payload", "payload_digest", "refers_to").transform(common.map_batches, write, "path string"), "warc-streams-manifest")


def a_file_each(manifest: DataFrame) -> DataFrame:
    return manifest.repartitionByRange(max(1, manifest.count()), "path")


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrites the streams of a manifest (path) with a member per record; its manifest has path, index_path and n_records."""
    folder = common.shared_dir(manifest.sparkSession, "warc")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source_system, source_path = fs.FileSystem.from_uri(path)
                system, where = common.open_dir(folder)
                name, at, count = uuid.uuid4().hex, 0, 0
                with source_system.open_input_stream(source_path, compression=None) as source, system.open_output_stream(f"{where}/{name}.warc.gz", compression=None) as out, system.open_output_stream(f"{where}/{name}.idx", compression=None) as index:
                    for data, named in records(inflated(source)):
                        body = member(data)
                        out.write(body)
                        index.write(f"{named['warc-record-id']}\t{at}\t{len(body)}\n".encode())
                        at, count = at + len(body), count + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "index_path": [f"{folder}/{name}.idx"], "n_records": pa.array([count], pa.int64())})

    return common.stored(a_file_each(manifest).transform(common.map_batches, rewrite, "path string, index_path string, n_records long"), "warc-manifest")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def parsed(data: bytes) -> tuple:
    """READ's row of a record; intact: a response's payload has the digest and length of its head."""
    head, _, rest = data.partition(GAP)
    named = fields(head)
    http, _, payload = rest[: int(named["content-length"])].partition(GAP)
    size, digest = int(fields(http)["content-length"]), named["warc-payload-digest"].removeprefix("sha256:")
    revisit = named["warc-type"] == "revisit"
    intact = revisit or len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
    return id_of(named["warc-record-id"]), named.get("warc-target-uri"), size, digest, named["warc-type"], id_of(named["warc-refers-to"]) if revisit else None, intact


def read_records(manifest: DataFrame) -> DataFrame:
    """READ's row of every record of normalised archives, each inflated alone by its offset in the index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file in batch.to_pylist():
                system, where = fs.FileSystem.from_uri(file["path"])
                _, index = fs.FileSystem.from_uri(file["index_path"])
                with system.open_input_file(where) as source, system.open_input_stream(index, compression=None) as lines:
                    for line in lines.read().splitlines():
                        _, at, size = line.split(b"\t")
                        source.seek(int(at))
                        yield parsed(zlib.decompress(source.read(int(size)), GZIP))

    return a_file_each(manifest).transform(common.map_batches, lambda batches: common.rows_to_batches(rows(batches), READ), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
