"""Lists of many pages as a Spark data source, for batches and streams.

A folder holds a page a file, named by the page's cursor. `linked` pages name
the next one themselves (pages.NEXT_ROW), so they are followed one after
another; `numbered` ones are 1, 2, 3 ... up to the first that is missing, and
are dealt to tasks.

As a stream the offset is the last page that was handed out and how many there
were: Spark keeps it in the query's checkpoint, reads on from there after a
stop, and asks for the same pages again if it stopped before the sink was
done. A page that is linked or added later is found at the next look.

    spark.dataSource.register(PageChain)
    spark.read.format("page_chain").options(path=..., start="td?y=0").load()
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidemark.sources.pages import NEXT_ROW

SCHEMA = "page long, cursor string, html string, next string"
SUFFIX = ".page"
#: Numbered pages that a task reads, and pages that a look of a stream takes if no option says otherwise.
PAGES_A_TASK, MOST = 64, 100


def file_name(cursor: str) -> str:
    return quote(cursor, safe="") + SUFFIX


class Folder:
    """The pages of a folder that every process can reach."""

    def __init__(self, path: str) -> None:
        self.system, self.at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def fetch(self, cursor: str) -> str | None:
        file = f"{self.at.rstrip('/')}/{file_name(cursor)}"
        if self.system.get_file_info(file).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(file) as f:
            return f.read().decode("utf-8", "replace")

    def put(self, cursor: str, page: str) -> None:
        self.system.create_dir(self.at, recursive=True)
        with self.system.open_output_stream(f"{self.at.rstrip('/')}/{file_name(cursor)}") as f:
            f.write(page.encode())

    def numbers(self) -> int:
        """How many numbered pages there are before the first missing one."""
        found = {unquote(i.base_name.removesuffix(SUFFIX)) for i in self.system.get_file_info(fs.FileSelector(self.at, allow_not_found=True)) if i.base_name.endswith(SUFFIX)}
        n = 0
        while str(n + 1) in found:
            n += 1
        return n


def next_link(page: str, dead_ends: dict[str, str]) -> str:
    """Where a linked page's list goes on; '' at its end. dead_ends: links that lead nowhere, and where the list goes on."""
    m = re.search(NEXT_ROW, page)
    link = html.unescape(m[1]).replace("/", "").replace("&pg=true", "") if m else ""
    return dead_ends.get(link, link)


class Chain:
    """Pages in order, as rows of SCHEMA, the first with page 1."""

    def __init__(self, options: dict) -> None:
        self.folder, self.numbered = Folder(options["path"]), options.get("kind", "linked") == "numbered"
        self.start, self.most = "1" if self.numbered else options.get("start", ""), int(options.get("most", MOST))
        self.dead_ends = json.loads(options.get("dead_ends", "{}"))

    def following(self, cursor: str, page: str) -> str:
        return str(int(cursor) + 1) if self.numbered else next_link(page, self.dead_ends)

    def rows(self, after: str, page: int, upto: int | None) -> Iterator[tuple]:
        """Pages behind `after` ('' before the first), which was number `page`; none beyond number `upto`."""
        cursor = self.start
        if after:
            last = self.folder.fetch(after)
            cursor = "" if last is None else self.following(after, last)
        while cursor and (upto is None or page < upto) and (text := self.folder.fetch(cursor)) is not None:
            page += 1
            onward = self.following(cursor, text)
            yield page, cursor, text, onward or None
            cursor = onward


class Numbers(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class ChainReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.most = options, int(options["most"]) if "most" in options else None

    def partitions(self) -> list[Numbers]:
        chain = Chain(self.options)
        if not chain.numbered:
            return [Numbers(0, -1)]
        n = min(chain.folder.numbers(), self.most) if self.most is not None else chain.folder.numbers()
        return [Numbers(k, min(n, k + PAGES_A_TASK)) for k in range(0, n, PAGES_A_TASK)]

    def read(self, partition: Numbers) -> Iterator[tuple]:
        chain = Chain(self.options)
        if not chain.numbered:
            yield from chain.rows("", 0, self.most)
        elif partition is not None:
            yield from chain.rows(str(partition.low) if partition.low else "", partition.low, partition.high)


class ChainStream(SimpleDataSourceStreamReader):
    """The offset: `after`, the cursor of the last page handed out, and `page`, its number."""

    def __init__(self, options: dict) -> None:
        self.chain = Chain(options)

    def initialOffset(self) -> dict:
        return {"after": "", "page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self.chain.rows(start["after"], start["page"], start["page"] + self.chain.most))
        return iter(rows), {"after": rows[-1][1], "page": rows[-1][0]} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.chain.rows(start["after"], start["page"], end["page"])


class PageChain(DataSource):
    """Options: path; kind (linked or numbered); start, the first cursor of a linked chain; most, the pages of a batch or of a look; dead_ends, a JSON object."""

    @classmethod
    def name(cls) -> str:
        return "page_chain"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChainReader:
        return ChainReader(dict(self.options))

    def simpleStreamReader(self, schema) -> ChainStream:
        return ChainStream(dict(self.options))


def read_chain(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PageChain)
    return spark.read.format("page_chain").options(path=path, **options).load()


def stream_chain(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PageChain)
    return spark.readStream.format("page_chain").options(path=path, **options).load()


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (cursor, html) as files of a folder; a page that a lost task had written is written again with the same content."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(path)
        for b in batches:
            for cursor, page in zip(b.column("cursor").to_pylist(), b.column("html").to_pylist(), strict=True):
                folder.put(cursor, page or "")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    pages.select("cursor", "html").mapInArrow(put, "n long").agg(F.sum("n")).collect()
