"""Operator 13: how far the sources of a language differ in the terms they use, by exact sums over DuckDB shards.

Terms are runs of letters and other characters beyond ASCII, A-Z lower-cased.
A language keeps the V terms that at least LEAST_DOCS of its documents have.
A group is a pair (lang, source); it gives every kept term the weight
p = 1 + floor(SCALE * (count + 1) / (N + V)), N the sum of its counts of kept
terms; a language as a whole does the same. Two weights of a term differ by
f = floor((p - q)^2 / q). All of it is whole numbers.

1. A task counts the terms of its texts by group: a row per group and term,
   however often it occurs there.
2. Rows are dealt to shards by a hash of lang and term, so a shard has all
   counts of its terms. SQL in the shard sums them and keeps the terms of
   enough documents. Spark sums N and V.
3. The kept counts with their weights go to shards in the same way; SQL there
   sums, for every two sources that both have a term, f less what it would be
   if either or both lacked the term, and ranks the terms of each group.
4. Spark adds what the terms give that a source lacks. It has there the weight
   p0 of count 0, so the sum needs no list of terms: only how many terms have
   each count, and how many the sources have. Rankings are merged at the end.

The work of a shard grows with its counts and, as the result does, with the
square of the number of sources that share a term; a source that holds most
rows is one of them and no more. DuckDB runs on one thread with a memory
limit and spills to the executor's own temporary folder, which goes with the
task.

Null texts, languages and sources count as ''. Rows are documents, so repeated
rows count each. Texts without terms still make their group occur. A language
with no kept term gives the value 0 for its pairs. Ties are ranked by the
item's UTF-8. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Fixed values of the measure.
LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
#: A term is a run of these bytes of UTF-8; A-Z become a-z, all else separates.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: What a task counts before it gives its rows: entries, and bytes of texts.
HELD_TERMS, HELD_BYTES = 400_000, 64 << 20
SHARD_MEMORY = "256MB"
BROADCAST_GROUPS = 100_000

COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED: occurrences and documents of each term by group, of a stretch of the task's texts."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = size = 0

    def rows() -> Iterator[tuple]:
        for (lang, source), (n, docs) in groups.items():
            for term, k in n.items():
                yield lang, source, term, k, docs[term]

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def flushed() -> Iterator[pa.RecordBatch]:
        for b in common.rows_to_batches(rows(), schema, 1 << 14):
            yield b.set_column(2, "term", b.column("term").cast(pa.string()))

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            terms = raw.to_pybytes().translate(LETTERS).split(b" ") if raw is not None and raw.size else []
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own = set(terms) - {b""}
            before = len(docs)
            n.update(filter(None, terms))
            docs.update(own)
            held += len(docs) - before
            size += raw.size if raw is not None else 0
            if held > most or size > HELD_BYTES:
                yield from flushed()
                groups.clear()
                held = size = 0
    yield from flushed()


def sharded(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of SQL over each shard, the rows of a partition, which it knows as the table `shard`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        rest = pa.RecordBatchReader.from_batches(first.schema, (b for some in ([first], batches) for b in some))
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": SHARD_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.register("rest", rest)
            con.execute("CREATE TEMP TABLE shard AS SELECT * FROM rest")
            yield from con.sql(sql).to_arrow_reader(1 << 14)

    return df.repartition("lang", "term").transform(common.map_batches, run, schema)


#: The counts of the terms that enough documents of a language have; first marks one row of each term.
KEPT_SQL = f"""
WITH counts AS (
  SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM shard GROUP BY lang, term, source),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n, min(source) AS least FROM counts GROUP BY lang, term HAVING sum(docs) >= {LEAST_DOCS})
SELECT lang, term, source, n, lang_n, source = least AS first FROM counts JOIN kept USING (lang, term)"""

def apart_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


#: For two sources with the term, f less what stands for a lacking term on either side; and the first terms of each group.
SUMS_SQL = f"""
SELECT 'pair' AS part, a.lang, a.source, b.source AS item,
  CAST(sum({apart_sql("a.p", "b.p")} - {apart_sql("a.p", "b.p0")} - {apart_sql("a.p0", "b.p")} + {apart_sql("a.p0", "b.p0")}) AS BIGINT) AS value
FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT 'term', lang, source, term, value FROM (SELECT lang, source, term, {apart_sql("p", "q")} AS value FROM shard WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP_TERMS}"""


def weight(n: Column, total: Column, kept: Column) -> Column:
    """p of a count; the product may be beyond 64 bits."""
    product = F.lit(SCALE).cast("decimal(19,0)") * (n + 1).cast("decimal(18,0)")
    return F.call_function("div", product, (total + kept).cast("decimal(18,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """f of two weights; its square is below 2^63 as a weight is at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, which are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: `pair` for every other source of the language, `term` for the TOP_TERMS terms that a group overuses most."""
    most = HELD_TERMS
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), common.text_of().alias("text"))
    counted = plain.transform(common.map_batches, lambda b: term_counts(b, most), COUNTED)
    kept = common.stored(sharded(counted, KEPT_SQL, "lang string, term string, source string, n long, lang_n long, first boolean"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "v", "lang_total"])
    zero = F.lit(0).cast("bigint")
    # a language without terms has no weights, and needs none
    p0 = F.when(F.col("v") > 0, weight(zero, F.col("total"), F.col("v")))
    groups = common.stored(groups.withColumn("p0", p0), "divergence-groups")
    known = small(groups)

    weighed = kept.join(known, ["lang", "source"]).select("lang", "term", "source", weight(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", weight(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    found = common.stored(sharded(weighed, SUMS_SQL, "part string, lang string, source string, item string, value long"), "divergence-sums")

    # terms that one side has, as if the other lacked them: by the weights that occur, not by terms
    often = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(known, ["lang", "source"]).select("lang", F.col("source").alias("mine"), "m", weight(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    others = small(groups.select("lang", F.col("source").alias("theirs"), F.col("p0").alias("q")))
    sides = often.join(others, "lang").where("mine <> theirs").groupBy("lang", "mine", "theirs").agg(F.sum(F.col("m") * apart(F.col("p"), F.col("q"))).alias("out"), F.sum(F.col("m") * apart(F.col("q"), F.col("p"))).alias("back"))
    ways = F.explode(F.array(F.struct(F.col("mine").alias("source"), F.col("theirs").alias("item"), F.col("out").alias("value")), F.struct(F.col("theirs").alias("source"), F.col("mine").alias("item"), F.col("back").alias("value"))))
    one_has = sides.select("lang", ways.alias("way")).select("lang", "way.source", "way.item", "way.value")
    # and those that neither has; terms that both have are taken off twice here and put back once by the shards
    other = small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"), F.col("terms").alias("item_terms")))
    lack = (F.col("v") - F.col("terms") - F.col("item_terms")) * apart(F.col("p0"), F.col("q"))
    none_has = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, lack).otherwise(zero).alias("value"))
    pairs = found.where("part = 'pair'").drop("part").unionByName(one_has).unionByName(none_has).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = pairs.withColumn("part", F.lit("pair")).unionByName(found.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")


#: The same over dense lists of terms, for DuckDB.
AUDIT_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS BIGINT) AS p,
    CAST(1 + (CAST({SCALE} AS HUGEINT) * (k.lang_n + 1)) // (v.lang_total + v.v) AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
