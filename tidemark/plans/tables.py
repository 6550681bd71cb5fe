"""Queries of the relational surface: filters, joins, upserts, sets, paging, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import q4
from tidemark.functions import cleaning as C
from tidemark.operators import fundamentals, paging, prices, substrings
from tidemark.operators import relational as R
from tidemark.plans.catalogue import query
from tidemark.plans.market import BARS, DISC, FIN, W, sq4
from tidemark.sources import entities, pages


def disclosures(spark, sf_dir):
    return entities.disclosures(spark, sf_dir)


EXCLUDED_TITLES = ("not spec", "^5-")


@query(f"WITH {DISC} SELECT id, code, title FROM disc WHERE code IS NOT NULL AND trim(place) = 'O' AND NOT coalesce(regexp_matches(title, '(?i)(?:not spec)|(?:^5-)'), false)")
def disclosure_filter(spark, sf_dir):
    return R.kept(disclosures(spark, sf_dir), "code", {"title": EXCLUDED_TITLES}, ("place", "O")).select("id", "code", "title")


@query(f"WITH {DISC} SELECT id, code, title FROM disc WHERE code IS NOT NULL AND NOT coalesce(regexp_matches(title, '(?i)(?:not spec)|(?:^5-)'), false)")
def press_filter(spark, sf_dir):
    return R.kept(disclosures(spark, sf_dir), "code", {"title": EXCLUDED_TITLES}).select("id", "code", "title")


@query("SELECT c_custkey AS id, name FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 10) ELSE c_name END AS name FROM customer) WHERE NOT regexp_matches(name, '(?i)(?:0{5}1)') AND NOT regexp_matches(name, '^[0-9]+$')")
def backfill_filter(spark, sf_dir):
    """Customers whose name isn't excluded and isn't all digits; a third of the names here are."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.substring("c_name", 10, 100)).otherwise(F.col("c_name"))
    rows = entities.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return R.kept(rows, "id", {"name": ["0{5}1"]}).where(~F.col("name").rlike("(?U)^\\d+$"))


@query(f"WITH {DISC} SELECT count(*) AS n, max(date) AS last_day FROM disc WHERE date > DATE '1998-01-01'")
def cutoff_filter(spark, sf_dir):
    return disclosures(spark, sf_dir).where(F.col("date") > F.lit("1998-01-01").cast("date")).agg(F.count("*").alias("n"), F.max("date").alias("last_day"))


@query("SELECT event_id FROM events WHERE ts::DATE::VARCHAR >= '2024-01-05' AND ts::DATE::VARCHAR < '2024-01-12'")
def half_open_range(spark, sf_dir):
    day = F.to_date("ts").cast("string")
    return entities.table(spark, sf_dir, "events").where((day >= "2024-01-05") & (day < "2024-01-12")).select("event_id")


@query(f"WITH {DISC} SELECT id, code, title, day FROM (SELECT *, day(date) AS day FROM disc) d WHERE d.date >= DATE '1997-01-01' AND NOT EXISTS (SELECT 1 FROM disc o WHERE o.date < DATE '1997-01-01' AND o.code IS NOT DISTINCT FROM d.code AND o.title IS NOT DISTINCT FROM d.title AND day(o.date) = d.day)")
def new_rows_anti(spark, sf_dir):
    """Disclosures whose code, title and day of the month no stored one has."""
    rows, cut = disclosures(spark, sf_dir).withColumn("day", F.dayofmonth("date").cast("bigint")), F.lit("1997-01-01").cast("date")
    return R.new_rows(rows.where(F.col("date") >= cut), rows.where(F.col("date") < cut), ["code", "title", "day"]).select("id", "code", "title", "day")


@query(f"""WITH {DISC}, r AS (SELECT *, CASE WHEN date < DATE '1997-01-01' THEN 0 ELSE 1 END side FROM disc)
SELECT code, title, arg_max(total, (side * 1000000000000 + id)) AS total, arg_max(id, (side * 1000000000000 + id)) AS id, min(side)::INTEGER AS place_side, min(side * 1000000000000 + id) % 1000000000000 AS place FROM r GROUP BY code, title""")
def upsert_last_wins(spark, sf_dir):
    rows, cut = disclosures(spark, sf_dir).select("id", "code", "title", "total", "date"), F.lit("1997-01-01").cast("date")
    return R.upsert(rows.where(F.col("date") < cut).drop("date"), rows.where(F.col("date") >= cut).drop("date"), ["code", "title"], "id")


@query("SELECT user_id, event_id, source FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END source FROM events) QUALIFY source = min(source) OVER (PARTITION BY user_id)")
def source_fallback(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return R.first_source(entities.table(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("source")), "user_id", "source")


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_press(spark, sf_dir):
    named = lambda t, k, n, kind: entities.table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("kind"))
    return named("customer", "c_custkey", "c_name", "customer").unionByName(named("supplier", "s_suppkey", "s_name", "supplier"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def merge_stored_new(spark, sf_dir):
    stored = entities.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = entities.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return stored.unionByName(new, allowMissingColumns=True)


@query("SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) stop FROM events) WHERE stop = 0")
def take_while_day(spark, sf_dir):
    return R.take_while(entities.table(spark, sf_dir, "events"), F.col("event_type") != "purchase", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT p_partkey AS part, min(s_suppkey) AS code, arg_min(s_name, s_suppkey) AS name FROM (SELECT *, lpad((p_partkey % 50)::VARCHAR, 2, '0') needle FROM part) JOIN supplier ON contains(s_name, needle) GROUP BY p_partkey")
def name_code_lookup(spark, sf_dir):
    needles = entities.table(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") % 50).cast("string"), 2, "0").alias("needle"), F.col("p_partkey").alias("part"))
    found = substrings.first_holding(entities.companies(spark, sf_dir), needles, "name", "needle", "code")
    return substrings.merged(needles, found, "needle").select("part", "code", "name")


@query("""WITH n AS (SELECT p_partkey AS part, lpad(p_partkey::VARCHAR, (3 + p_partkey % 4)::INTEGER, '0') AS needle FROM part)
SELECT part, needle, code, name FROM n JOIN (SELECT needle, min(c_custkey) AS code, arg_min(c_name, c_custkey) AS name FROM (SELECT DISTINCT needle FROM n) JOIN customer ON contains(c_name, needle) GROUP BY needle) USING (needle)""")
def name_index_lookup(spark, sf_dir):
    """The first customer whose name holds a part's number, written with three to six digits."""
    key = F.col("p_partkey")
    needles = entities.table(spark, sf_dir, "part").select(key.alias("part"), F.lpad(key.cast("string"), (3 + key % 4).cast("int"), F.lit("0")).alias("needle"))
    names = entities.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return substrings.merged(needles, substrings.first_holding(names, needles, "name", "needle", "code"), "needle").select("part", "needle", "code", "name")


@query("SELECT o_orderkey AS id, coalesce(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), '') AS text FROM orders LEFT JOIN documents ON doc_id = o_orderkey")
def text_lookup_left(spark, sf_dir):
    docs = entities.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.trim(F.regexp_replace("text", r"[\s]+", " ")).alias("text"))
    rows = entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.join(docs, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


@query("SELECT conv_id, count_if(coalesce(regexp_matches(text, '(?i)^(Error[:：]|\\bError\\b)') AND NOT contains(text, 'URL'), false))::BIGINT AS errors, count_if(coalesce(regexp_matches(text, '(?i)^(Error[:：]|\\bError\\b)') AND NOT contains(text, 'URL'), false)) < 5 AS passed FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'Error: ' || text WHEN turn % 3 = 0 THEN 'error URL ' || text ELSE text END AS text FROM conversations) GROUP BY conv_id")
def error_gate(spark, sf_dir):
    marked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Error: "), "text")).when(F.col("turn") % 3 == 0, F.concat(F.lit("error URL "), "text")).otherwise(F.col("text"))
    return R.error_gate(entities.table(spark, sf_dir, "conversations").select("conv_id", marked.alias("text")), "text", "conv_id")


@query(f"WITH {DISC} SELECT strftime(date, '%Y-%m-%d') AS date_key, count(*) AS n FROM disc GROUP BY 1")
def partition_counts(spark, sf_dir):
    return disclosures(spark, sf_dir).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date_key")).agg(F.count("*").alias("n"))


@query(f"WITH {BARS}, x AS (SELECT DISTINCT date AS day FROM bars) SELECT a.day, min(b.day) AS next_day FROM x a JOIN x b ON b.day > a.day AND b.day <= a.day + 10 GROUP BY a.day")
def next_available_day(spark, sf_dir):
    return R.next_day(entities.bars(spark, sf_dir), "date")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) rn FROM conversations) WHERE rn > 2 AND rn <= 4")
def page_slice(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return entities.table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(w)).where("rn > 2 and rn <= 4").select("conv_id", "turn")


@query("""WITH p AS (SELECT user_id, event_id, event_type, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5)::BIGINT page FROM events),
c AS (SELECT user_id, min(page) cut FROM (SELECT user_id, page FROM p GROUP BY 1, 2 HAVING count_if(event_type = 'click') = 0) GROUP BY 1)
SELECT p.user_id, event_id, page FROM p LEFT JOIN c USING (user_id) WHERE event_type = 'click' AND (cut IS NULL OR page < cut)""")
def page_loop_early_stop(spark, sf_dir):
    rows = R.paged(entities.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["ts", "event_id"], 5, ["user_id"])
    return R.until_empty_page(rows, F.col("event_type") == "click", ["user_id"]).select("user_id", "event_id", "page")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 25)::BIGINT AS page FROM events")
def global_pages(spark, sf_dir):
    """The page of every event in the whole table's order of time."""
    return paging.pages(entities.table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 25).select("event_id", "page")


@query("SELECT event_id, rn - 1 AS number FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn > 100 AND rn <= 150")
def global_page_slice(spark, sf_dir):
    """The page at offset 100 with 50 rows, newest first."""
    return paging.slice_rows(entities.table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), "event_id"], 100, 50).select("event_id", "number")


@query("""WITH p AS (SELECT event_id, event_type, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 5)::BIGINT page FROM events),
c AS (SELECT coalesce(min(page), 9223372036854775807) cut FROM (SELECT page FROM p GROUP BY page HAVING count_if(event_type = 'click') = 0))
SELECT event_id, page FROM p, c WHERE event_type = 'click' AND page < cut""")
def global_page_loop(spark, sf_dir):
    """Clicks on the pages of the whole table, up to the first page without any."""
    paged = paging.pages(entities.table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"], 5)
    return paging.until_empty(paged, F.col("event_type") == "click").select("event_id", "page")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events")
def time_desc(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return entities.table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT (SELECT count(*) > 0 FROM documents) AS has_work, (SELECT count(*) > 0 FROM labels) AS has_model, (SELECT count(*) > 0 FROM labels WHERE toxic > 1) AS has_eval")
def state_flags(spark, sf_dir):
    t = lambda n: entities.table(spark, sf_dir, n)
    flags = [t("documents").limit(1).agg((F.count("*") > 0).alias("has_work")), t("labels").limit(1).agg((F.count("*") > 0).alias("has_model")), t("labels").where("toxic > 1").limit(1).agg((F.count("*") > 0).alias("has_eval"))]
    one = flags[0]
    for f in flags[1:]:
        one = one.crossJoin(F.broadcast(f))  # single rows
    return one


@query("SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) - CASE dayofweek(o_orderdate) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS weekday, last_day(o_orderdate) AS month_end, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS ahead, o_orderdate::DATE - 200 AS back, o_orderdate::DATE + 90 AS later FROM orders")
def weekday_adjust(spark, sf_dir):
    day = F.to_date("o_orderdate")
    back = F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0)
    return entities.table(spark, sf_dir, "orders").select(day.alias("date"), F.date_sub(day, back).alias("weekday"), F.last_day(day).alias("month_end"), F.add_months(day, 3).alias("ahead"), F.date_sub(day, 200).alias("back"), F.date_add(day, 90).alias("later"))


@query(f"WITH {FIN} SELECT code, year, last_day(strptime(substr(year, 1, 4) || right(year, 2) || '01', '%Y%m%d')::DATE) AS month_end FROM fin")
def month_end(spark, sf_dir):
    day = F.last_day(F.to_date(F.concat(F.substring("year", 1, 4), F.right(F.col("year"), F.lit(2))), "yyyyMM"))
    return entities.financials(spark, sf_dir).select("code", "year", day.alias("month_end"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(props->>'missing', 'none') AS missing FROM events")
def json_get(spark, sf_dir):
    return entities.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query(f"WITH {BARS} SELECT code, date, close::BIGINT AS close FROM bars")
def json_flatten(spark, sf_dir):
    """Each series as a JSON text of records, and the records again."""
    rows = entities.bars(spark, sf_dir).select("code", "date", F.col("close").cast("bigint").alias("close"))
    text = rows.groupBy("code").agg(F.to_json(F.collect_list(F.struct("date", "close"))).alias("series"))
    return text.select("code", F.inline(F.from_json("series", "array<struct<date date, close bigint>>")))


@query(f"WITH {BARS} SELECT code, date, [open::BIGINT, high::BIGINT, low::BIGINT, close::BIGINT] AS vector, close::BIGINT AS named FROM bars")
def dict_vector(spark, sf_dir):
    keys = ("open", "high", "low", "close")
    record = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(k).cast("bigint") for k in keys)))
    return entities.bars(spark, sf_dir).select("code", "date", record.alias("r")).select("code", "date", F.transform(F.array(*map(F.lit, keys)), lambda k: F.col("r")[k]).alias("vector"), F.col("r")["close"].alias("named"))


@query("SELECT doc_id, count(*) AS chunks, min(n) AS last_chunk FROM (SELECT doc_id, unnest(range(0, greatest(1, n), 512)) s, n - unnest(range(0, greatest(1, n), 512)) n FROM (SELECT doc_id, len(string_split(text, ' '))::BIGINT n FROM documents)) GROUP BY doc_id")
def chunk512(spark, sf_dir):
    """Texts cut into chunks of 512 blank-separated words: how many, and the size of the last."""
    words = F.split("text", " ")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 512).cast("int")), lambda k: F.slice("w", k * 512 + 1, F.lit(512)))
    return entities.table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", chunks.alias("c")).select("doc_id", F.size("c").cast("bigint").alias("chunks"), F.size(F.element_at("c", -1)).cast("bigint").alias("last_chunk"))


@query("SELECT label, i, floor(avg(x) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS mean FROM (SELECT label, unnest(range(0, 64))::INTEGER i, unnest(embedding)::DOUBLE x FROM embeddings) GROUP BY label, i")
def vector_mean_pool(spark, sf_dir):
    each = entities.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(q4(F.avg(F.col("x").cast("double"))).alias("mean"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), c AS (SELECT label, list(m ORDER BY i) m FROM (SELECT label, i, avg(x) m FROM (SELECT label, unnest(range(0, 64)) i, unnest(e) x FROM v) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, floor(list_sum(list_transform(list_zip(e, m), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e, lambda x: x * x)) * list_sum(list_transform(m, lambda x: x * x))) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS cosine FROM v JOIN c USING (label)""")
def cosine_to_centre(spark, sf_dir):
    """Each vector's cosine with the mean of its label."""
    v = entities.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("e", "m") / F.sqrt(dot("e", "e") * dot("m", "m"))
    return v.join(centres, "label").select("vec_id", (F.floor(cosine * 1000.0 + 0.5) / 1000.0).alias("cosine"))


@query(f"WITH {BARS}, r AS (SELECT (lead(close, 3) OVER {W} - close) / close * 100 y3, (lead(close, 7) OVER {W} - close) / close * 100 y7 FROM bars) SELECT {sq4('avg(y3 * y3) / 10000')} AS mse3, {sq4('avg(y7 * y7) / 10000')} AS mse7 FROM r")
def mse_by_horizon(spark, sf_dir):
    """The mean squared error of predicting no change."""
    rates = prices.change_rates(entities.bars(spark, sf_dir), (3, 7))
    return rates.agg(*(q4(F.avg(F.col(f"rate_{d}") * F.col(f"rate_{d}")) / 10000).alias(f"mse{d}") for d in (3, 7)))


@query("SELECT event_type, count(*) AS n, count_if(value > 100)::BIGINT AS large, bool_or(value > 480) AS any_top, bool_and(value > 0) AS all_positive FROM events GROUP BY event_type")
def counts_any_all(spark, sf_dir):
    v = F.col("value")
    return entities.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v > 100).alias("large"), F.bool_or(v > 480).alias("any_top"), F.bool_and(v > 0).alias("all_positive"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def first_last(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return entities.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@query("SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM events")
def null_normalised(spark, sf_dir):
    """Missing values written as NaN or infinity become null."""
    v = F.when(F.col("value") < 2, F.lit(float("nan"))).when(F.col("value") < 5, F.lit(float("inf"))).otherwise(F.col("value"))
    clean = F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))
    return entities.table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", clean.alias("value"))


# --- reading numbers, names and errors ---


@query("SELECT o_orderkey AS id, floor(o_totalprice)::DOUBLE AS total, NULL::DOUBLE AS other, 0.0::DOUBLE AS dividends, 0.0::DOUBLE AS splits FROM orders")
def thousands_numbers(spark, sf_dir):
    """Totals written with thousands separators, read again; what isn't a number is null; columns that a source lacks are 0."""
    text = F.format_number(F.floor("o_totalprice"), 0)
    rows = entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t"))
    return pages.with_constants(rows.select("id", pages.number(F.col("t")).alias("total"), pages.number(F.concat("t", F.lit("---"))).alias("other")))


@query("SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://x/d/' || o_orderkey END AS url FROM orders")
def title_path_split(spark, sf_dir):
    plain = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit("=>/d/"), F.col("o_orderkey").cast("string")))
    rows = entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), plain.alias("t"))
    title, url = pages.title_and_path(F.col("t"), "https://x/")
    return rows.select("id", title.alias("title"), url.alias("url"))


@query(f"""WITH {FIN}, x AS (SELECT code, year, CASE WHEN code % 2 = 0 THEN NULL ELSE try_cast(eps AS DOUBLE) END AS e, try_cast(fin.equity AS DOUBLE) q, shares * 1.0::DOUBLE AS t, CASE WHEN code % 5 = 0 THEN NULL ELSE try_cast(bps AS DOUBLE) END b, code % 5 = 0 AS blank
  FROM fin JOIN fin1 USING (code) WHERE fin1.y || '/03' = fin.year),
y AS (SELECT code, year, e, t - code AS s, CASE WHEN blank THEN q / nullif(t - code, 0) ELSE b END AS bb FROM x)
SELECT code, year, {sq4('e')} AS eps, {sq4('bb')} AS bps, {sq4('1000 / nullif(e, 0)')} AS per, {sq4('1000 / nullif(bb, 0)')} AS pbr, {sq4('1000 * s')} AS cap FROM y""")
def statement_ratios(spark, sf_dir):
    """Ratios of statements at a price of 1000; half of them have no eps, a fifth no bps."""
    fin = entities.financials(spark, sf_dir)
    shares = entities.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.concat(F.year("l_shipdate").cast("string"), F.lit("/03")).alias("year")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    blank = lambda c, by: F.when(F.col("code") % by == 0, F.lit("")).otherwise(F.col(c)).alias(c)
    rows = fin.join(shares, ["code", "year"]).select("code", "year", F.lit(1000.0).alias("price"), blank("eps", 2), blank("bps", 5), "equity", F.col("n").cast("string").alias("total_shares"), F.col("code").cast("string").alias("treasury_shares"))
    return fundamentals.statement_ratios(rows).select("code", "year", *(q4(F.col(c)).alias(c) for c in ("eps", "bps", "per", "pbr", "cap")))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Failed to download PDF' WHEN event_id % 7 = 1 THEN '★Error 想定外のエラーが発生しました: ' || event_type WHEN event_id % 7 = 2 THEN 'No readable text found' ELSE event_type END AS text FROM events")
def error_sentinels(spark, sf_dir):
    k = F.col("event_id") % 7
    text, error = F.when(k == 2, F.lit("")).otherwise(F.col("event_type")), F.when(k == 1, F.col("event_type"))
    return entities.table(spark, sf_dir, "events").select("event_id", C.or_sentinel(text, k != 0, error).alias("text"))


@query("SELECT conv_id, string_agg('above ' || turn || chr(10) || chr(10) || '{''table'': 「' || role || ' | ' || turn || '」}', chr(10) || chr(10) ORDER BY turn DESC) || chr(10) || chr(10) || 'below' AS text FROM conversations GROUP BY conv_id")
def document_tables(spark, sf_dir):
    """Each conversation as a page: a table per turn, later turns higher up, above each a text that repeats its table."""
    cells = F.array(F.array("role", F.col("turn").cast("string")))
    # first and last row are one, so what is repeated runs from its first to its last ten characters
    own = F.concat("role", F.lit(" "), F.col("turn").cast("string"))
    twice = F.concat(F.lit("above "), F.col("turn").cast("string"), F.lit(" "), F.left(own, F.lit(10)), F.lit(" "), F.right(own, F.lit(10)))
    tables = F.collect_list(F.struct((-F.col("turn")).cast("double").alias("top"), twice.alias("before"), cells.alias("rows")))
    return entities.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tables.alias("t")).select("conv_id", C.document_text(F.lit("below"), F.col("t")).alias("text"))


@query("SELECT o_orderkey AS id, o_orderkey % 13 < 12 AS alert, o_orderkey % 8 < 7 AS important FROM orders")
def word_lists(spark, sf_dir):
    """Whether a text has one of the words that alert, or of the important ones; each word of both lists is looked for."""
    pick = lambda words: F.get(F.array(*map(F.lit, [*words, "なし"])), (F.col("o_orderkey") % (len(words) + 1)).cast("int"))
    rows = entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("本日の"), pick(C.ALERTS), F.lit("です")).alias("a"), F.concat(F.lit("本日の"), pick(C.IMPORTANT), F.lit("です")).alias("i"))
    return rows.select("id", C.holds_any(F.col("a"), C.ALERTS).alias("alert"), C.holds_any(F.col("i"), C.IMPORTANT).alias("important"))
