"""What runs keep between one another: tables in the shared folder, day lists, error lists, cursors and models.

Everything goes through Spark's readers and writers or the store's own file
system, so any path that Spark can open will do.

What is replaced as a whole (lists, cursors, models, day tables) is kept as
versions: new content goes to a folder of a new name, then a small commit file
that names it is renamed to the next number. A rename to a name that isn't
there is one step in any store that has renames, so whoever reads by the last
commit finds the old content or the new, whatever moment a writer is stopped
at. A path has one writer at a time; readers of the version before aren't
disturbed, older ones go with the next commit.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cleaning import company

#: Where local runs, as in tests, keep things if the session names no folder; executors of a cluster couldn't reach it.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors can reach; it isn't created yet."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_SHARED
    return f"{root.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once for all who use them, with no lineage that a lost executor could break."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything, in whatever store it is."""
    at, system = _at(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a path and what is below it; whether there was anything."""
    at, system = _at(spark, path)
    return system.exists(at) and system.delete(at, True)


# --- versions ---

COMMIT = ".commit-"


def _renamed(spark: SparkSession, source: str, path: str) -> None:
    """Moves source to path, which must be free."""
    at, system = _at(spark, path)
    system.mkdirs(at.getParent())
    if system.exists(at) or not system.rename(_at(spark, source)[0], at):
        raise OSError(f"{source} can't be moved to {path}")


def _names(spark: SparkSession, path: str) -> list[str]:
    at, system = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) and system.getFileStatus(at).isDirectory() else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at, system = _at(spark, path)
    out = system.create(at, False)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    at, system = _at(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits of a path, ascending."""
    return sorted(int(n.removeprefix(COMMIT)) for n in _names(spark, path) if n.startswith(COMMIT) and n.removeprefix(COMMIT).isdecimal())


def committed(spark: SparkSession, path: str) -> list[str] | None:
    """The lines of the last commit, or None if there is none. A commit that goes while it is looked at has a later one."""
    for _ in range(5):
        found = commits(spark, path)
        if not found:
            return None
        try:
            return read_bytes(spark, f"{path.rstrip('/')}/{COMMIT}{found[-1]:012}").decode().split("\n")
        except Exception as e:
            if "FileNotFound" not in str(e):
                raise
    raise OSError(f"the commits of {path} change too fast")


def commit(spark: SparkSession, path: str, lines: list[str]) -> int:
    """Makes lines the last commit; from here on readers see what they name."""
    path, found = path.rstrip("/"), commits(spark, path)
    number = found[-1] + 1 if found else 0
    fresh = f"{path}/.fresh-{uuid.uuid4().hex}"
    write_bytes(spark, fresh, "\n".join(lines).encode())
    _renamed(spark, fresh, f"{path}/{COMMIT}{number:012}")
    return number


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write() fills a new folder, which then is the content of path; the version before stays until the next."""
    path = path.rstrip("/")
    if exists(spark, path) and not _is_dir(spark, path):
        raise OSError(f"{path} is a file, not a path with versions")
    name = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    number = commit(spark, path, [name])
    kept = {name, f"{COMMIT}{number:012}", f"{COMMIT}{number - 1:012}"}
    if number:
        kept |= set(read_bytes(spark, f"{path}/{COMMIT}{number - 1:012}").decode().split("\n"))
    for old in _names(spark, path):
        if old not in kept and old.startswith(("v-", ".fresh-", COMMIT)):
            delete(spark, f"{path}/{old}")


def opened(spark: SparkSession, path: str) -> str | None:
    """Where the content of path is now: its last version, or path itself if others wrote it; None if there is nothing."""
    lines = committed(spark, path)
    if lines:
        return f"{path.rstrip('/')}/{lines[0]}"
    if any(n.startswith(("v-", ".fresh-")) for n in _names(spark, path)):
        return None  # a first version that was never committed
    return path if exists(spark, path) else None


# --- lists of records ---


def read_list(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of a JSON list, or of a record a line; no rows if the path is absent. Fields that a record lacks are null."""
    at = opened(spark, path)
    if at is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(at, multiLine=not _is_dir(spark, at))


def _is_dir(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.getFileStatus(at).isDirectory()


def rewrite_list(rows: DataFrame, path: str) -> None:
    """Writes the records in place of what is there; rows may come from that very path."""
    replace(rows.sparkSession, path, lambda to: rows.write.option("ignoreNullFields", "false").json(to))


def write_errors(rows: DataFrame, path: str, day: str) -> list[str]:
    """Each day's rows as the list `<day>_error`, in place of an older one; rows without a day are left out. The days' names are returned."""
    dated = rows.where(F.col(day).isNotNull()).withColumn("date_key", F.date_format(day, "yyyy-MM-dd"))
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    dated.write.partitionBy("date_key").option("ignoreNullFields", "false").json(fresh)
    spark = rows.sparkSession
    days = sorted(n.removeprefix("date_key=") for n in _names(spark, fresh) if n.startswith("date_key="))
    for name in days:
        replace(spark, f"{path.rstrip('/')}/{name}_error", lambda to, name=name: _renamed(spark, f"{fresh}/date_key={name}", to))
    delete(spark, fresh)
    return days


# --- tables by day ---

DAY_FOLDER = "date_key="


def read_days(spark: SparkSession, path: str, schema: T.StructType, days: list[str] | None = None) -> DataFrame:
    """The rows of a day table as of its last commit, with date_key; days: of these alone, others aren't opened."""
    lines = [x for x in committed(spark, path) or [] if x]
    if days is not None:
        wanted = {f"{DAY_FOLDER}{d}" for d in days}
        lines = [x for x in lines if x.split("/")[0] in wanted]
    whole = T.StructType([*(f for f in schema.fields if f.name != "date_key"), T.StructField("date_key", T.StringType())])
    if not lines:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*(f"{path.rstrip('/')}/{x}" for x in lines))


def replace_days(rows: DataFrame, path: str) -> list[str]:
    """The rows, which have date_key, in place of the days that they belong to; all of these change in one commit. The days' names."""
    spark, path, name = rows.sparkSession, path.rstrip("/"), f"v-{uuid.uuid4().hex}"
    rows.write.partitionBy("date_key").parquet(f"{path}/.{name}")
    held = {x.split("/")[0]: x for x in committed(spark, path) or [] if x}
    fresh = [n for n in _names(spark, f"{path}/.{name}") if n.startswith(DAY_FOLDER)]
    for day in fresh:
        _renamed(spark, f"{path}/.{name}/{day}", f"{path}/{day}/{name}")
    replaced = [held[d] for d in fresh if d in held]
    commit(spark, path, sorted((held | {d: f"{d}/{name}" for d in fresh}).values()))
    # what the commit before named stays for its readers; what was replaced earlier goes
    keep = {x.split("/")[1] for x in [*replaced, *(f"{d}/{name}" for d in fresh)]}
    for day in fresh:
        for old in _names(spark, f"{path}/{day}"):
            if old not in keep:
                delete(spark, f"{path}/{day}/{old}")
    for number in commits(spark, path)[:-2]:
        delete(spark, f"{path}/{COMMIT}{number:012}")
    delete(spark, f"{path}/.{name}")
    return sorted(d.removeprefix(DAY_FOLDER) for d in fresh)


# --- reference lists ---

#: The columns of the files that lists come in.
COMPANY_COLUMNS = ["date", "code", "name", *(f"more{k}" for k in range(1, 8))]
GROWTH_COLUMNS = ["date", "close", "open", "high", "low", "volume", "rate"]
STATEMENT_COLUMNS = ["code", "year", "assets", "net_assets", "equity", "retained", "short_loans", "long_loans", "bps", "equity_ratio", "sales", "operating", "ordinary", "profit", "eps", "roe", "roa"]


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """A CSV file's columns by place, as trimmed text; blank is null. Its own header, whatever it says, isn't a row."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=header, enforceSchema=True, multiLine=True, escape='"')
    return rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns))


def companies(spark: SparkSession, path: str) -> DataFrame:
    """code and name of the list of companies, by place; names as they are compared, each code once."""
    rows = read_csv(spark, path, COMPANY_COLUMNS).where("code is not null and name is not null")
    return rows.groupBy("code").agg(F.min("name").alias("name")).select("code", company(F.col("name")).alias("name"))


def growth_index(spark: SparkSession, path: str) -> DataFrame:
    """date and bars of the growth index's file; dates are YYYY/MM/DD or YYYY-MM-DD, numbers may have thousands separators."""
    rows = read_csv(spark, path, GROWTH_COLUMNS)
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double").alias(c)
    day = F.to_date(F.try_to_timestamp(F.replace(F.col("date"), F.lit("/"), F.lit("-")), F.lit("yyyy-M-d")))
    return rows.select(day.alias("date"), *(number(c) for c in ("open", "high", "low", "close", "volume"))).where("date is not null")


def keywords(spark: SparkSession, path: str) -> list[str]:
    """The words of a list without a header, in order, each once."""
    words = [r["word"] for r in read_csv(spark, path, ["word"], header=False).where("word is not null").collect()]  # written by hand
    return list(dict.fromkeys(words))


def guarded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, or no rows if one of them is missing."""
    if set(columns) <= set(rows.columns):
        return rows.select(*columns)
    return rows.sparkSession.createDataFrame([], T.StructType([T.StructField(c, dict((f.name, f.dataType) for f in rows.schema).get(c, T.StringType())) for c in columns]))


# --- cursors and models ---


class Cursor:
    """A place in a chain of pages. step() runs work from it and moves on only if that succeeds; the place before is kept as a backup, in the same commit."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _lines(self) -> list[str]:
        return [*(committed(self.spark, self.path) or []), "", ""][:2]

    def value(self) -> str | None:
        return self._lines()[0] or None

    def backup(self) -> str | None:
        return self._lines()[1] or None

    def advance(self, value: str) -> None:
        number = commit(self.spark, self.path, [value, self.value() or ""])
        for old in commits(self.spark, self.path):
            if old < number - 1:
                delete(self.spark, f"{self.path}/{COMMIT}{old:012}")

    def step(self, work: Callable[[str | None], str | None]) -> str | None:
        """work gets the cursor and returns the next, or None at the end; if it raises, nothing moves."""
        following = work(self.value())
        if following is not None:
            self.advance(following)
        return following


def packed_model(weights: Mapping[str, np.ndarray]) -> bytes:
    data = io.BytesIO()
    np.savez(data, **weights)
    return data.getvalue()


def unpacked_model(data: bytes) -> dict[str, np.ndarray] | None:
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as found:
            return dict(found)
    except (ValueError, OSError, KeyError):
        return None


MODEL_FILE = "weights.npz"


def save_model(spark: SparkSession, weights: Mapping[str, np.ndarray], path: str) -> None:
    """Named arrays as one file, in place of an older one."""
    replace(spark, path, lambda to: write_bytes(spark, f"{to}/{MODEL_FILE}", packed_model(weights)))


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    """The arrays, or None if there are none that can be read."""
    at = opened(spark, path)
    if at is None:
        return None
    file = f"{at}/{MODEL_FILE}" if _is_dir(spark, at) else at
    return unpacked_model(read_bytes(spark, file)) if exists(spark, file) else None
