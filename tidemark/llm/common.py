"""What the operators share: tables, the shared folder, the words of a text."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import shared_dir, stored

__all__ = ["BATCH_ROWS", "WORD", "WORD_GAP", "give_back", "lasting", "map_batches", "open_dir", "rows_to_batches", "shared_dir", "stored", "table", "text_of"]

#: Rows and bytes that go to Python at once, whichever is less: texts may be long, and the executor and its worker both hold a batch. A longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
ROWS_SETTING, BYTES_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

#: The ASCII white space that separates words: blank and \t \n \v \f \r.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder of the shared store, made if absent; for use inside tasks."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() with batches of at most BATCH_ROWS rows and BATCH_BYTES bytes.

    Spark reads both bounds when it plans a job, so they can't be set for one
    job alone: a session that allows more is set to these from now on.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ROWS_SETTING)) <= BATCH_ROWS:
        conf.set(ROWS_SETTING, str(BATCH_ROWS))
    held = conf.get(BYTES_SETTING)
    if not held.isdecimal() or not 0 < int(held) <= BATCH_BYTES:
        conf.set(BYTES_SETTING, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns to the system what a task has freed: a worker lives on, and an executor's workers and its JVM share one limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries without it give back by themselves
        ctypes.CDLL(None).malloc_trim(0)


_lasting: dict[object, object] = {}


def lasting[T](key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task. It keeps one object: another key's is dropped first, so the memories of a pipeline's stages don't add up."""
    if key not in _lasting:
        _lasting.clear()
        _lasting[key] = make()
    return _lasting[key]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rows_to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of `size` rows from tuples in the order of the schema."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
