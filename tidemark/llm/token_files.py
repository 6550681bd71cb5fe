"""Operator 1: token ids of a corpus as block-compressed binary files.

write_token_files() deals the documents out by range of their id, encodes
each range in one pass and writes it as one file of pfor.py's format; the
result is the manifest, a row per file, key and label. read_token_files() reads the
files back. A file gets a new name in every attempt of a task and only the
files of the manifest count, so a lost executor leaves nothing half-written
behind.

Null texts count as empty and still get the end id; a null doc_id stays null
and comes first; repeated rows are all kept; other columns are ignored; an
empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, pfor

END_ID = 0
MANIFEST = "path string, shard long, key string, label string, key_no long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, path: str | None = None, key: Column | None = None, end_id: int = END_ID, label: Column | None = None, remembered: int = bpe.LIMIT) -> DataFrame:
    """The manifest of the files, stored. key: documents are written by key, then by doc_id (default: by doc_id alone). label: told of each document, in no order (default: its key). remembered: words that a worker remembers."""
    folder = common.shared_dir(docs.sparkSession, "tokens")
    path, end = path or bpe.default_path(), end_id.to_bytes(4, "little")
    labels, names = ([], ("key", "key")) if label is None else ([label.alias("label")], ("key", "label"))
    dealt = (
        docs.select((F.lit("") if key is None else key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), *labels)
        .repartitionByRange("key", "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("key", "doc_id", F.xxhash64("text"), *names[1 : 1 + len(labels)])
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, out, totals = bpe.encoder(path, remembered).encode, None, None, {}
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfor"
        for batch in batches:
            if writer is None and batch.num_rows:
                system, where = common.open_dir(folder)
                out = system.open_output_stream(f"{where}/{name}")
                writer = pfor.Writer(out)
            for *k, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (*names, "doc_id", "text")), strict=True):
                ids = encode(text) + end
                total = totals.setdefault(tuple(k), [len(totals), 0, 0])
                writer.add(doc_id, ids, total[0])
                total[1] += 1
                total[2] += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{name}", "shard": shard, "key": k, "label": own, "key_no": no, "n_docs": d, "n_tokens": t} for (k, own), (no, d, t) in totals.items()],
                pa.schema([("path", pa.string()), ("shard", pa.int64()), ("key", pa.string()), ("label", pa.string()), ("key_no", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return common.stored(dealt.transform(common.map_batches, write, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`: ids of the same key in all files before. It has a row per file, key and label, not per document."""
    before = Window.partitionBy("key").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def per_file(manifest: DataFrame) -> DataFrame:
    """A row per file, a partition per file: path and its (key_no, key, base) in order."""
    files = common.stored(with_bases(manifest).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key_no", "key", "label", "base"))).alias("bases")), "token-files")
    return files.repartitionByRange(max(1, files.count()), "path")


def documents_of(path: str, bases: list[dict]) -> Iterator[tuple[str, str, int | None, int, object]]:
    """(key, label, doc_id, ids of the key before it, its ids) of a file; inside a task."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    at = {b["key"]: b["base"] for b in bases}
    names = {b["key_no"]: (b["key"], b["label"]) for b in bases}
    with system.open_input_file(where) as source:
        for no, doc_id, ids in pfor.Reader(source):
            key, label = names[no]
            yield key, label, doc_id, at[key], ids
            at[key] += len(ids)


def read_token_files(manifest: DataFrame, arrays: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, with arrays, ids."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * arrays
    schema = pa.schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file in batch.to_pylist():
                for _, _, doc_id, start, ids in documents_of(file["path"], file["bases"]):
                    yield (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if arrays else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.rows_to_batches(rows(batches), schema)

    return per_file(manifest).transform(common.map_batches, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays)
