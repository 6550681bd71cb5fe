"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import paging
from tidemark.plans.catalogue import query
from tidemark.sources import chain, entities, pages
from tidemark.sources.store import shared_dir


def docs(spark, sf_dir):
    return entities.table(spark, sf_dir, "documents")


def text(spark, sf_dir, c):
    return docs(spark, sf_dir).select("doc_id", c.alias("text"))


def sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


SPACES = r"[\s]+"


@query(sql(f"translate(text, '{C.WIDE}', '{C.NARROW}')"))
def zenkaku_hankaku(spark, sf_dir):
    return text(spark, sf_dir, C.narrowed(F.col("text")))


@query(sql(r"regexp_replace(text, '[\x{2000}-\x{200F}\x{FE0F}\x{2028}\x{2029}\x{2060}]+', '', 'g')"))
def invisible_chars(spark, sf_dir):
    return text(spark, sf_dir, C.without_invisible(F.col("text")))


@query(sql("regexp_replace(text, '(?i)copyright|©|section|Takasago International Corporation|\\(C\\)DyDoGroupHoldings\\.|Rentracks\\.|WATTMANN\\.CO\\.,LTD\\.|all rights reserved|SANKO TECHNO GROUP|FUJISOFT INCORPORATED|Science Arts Inc\\.', '。', 'g')"))
def noise_phrases(spark, sf_dir):
    return text(spark, sf_dir, C.without_noise(F.col("text")))


@query()
def url_mask(spark, sf_dir):
    return text(spark, sf_dir, F.regexp_replace("text", C.URL, "<URL>"))


@query()
def mail_mask(spark, sf_dir):
    return text(spark, sf_dir, F.regexp_replace("text", C.MAIL, "<MAIL>"))


@query()
def phone_mask(spark, sf_dir):
    return text(spark, sf_dir, F.regexp_replace("text", C.PHONE, "<PHONE>"))


@query()
def footer_trim(spark, sf_dir):
    return text(spark, sf_dir, C.without_footer(F.concat("text", F.lit(" お問い合わせ 以上"))))


@query()
def header_trim(spark, sf_dir):
    return text(spark, sf_dir, C.without_header(F.concat(F.lit("A OVERVIEW "), F.col("text"))))


@query()
def clean_texts(spark, sf_dir):
    """The whole chain over documents."""
    return text(spark, sf_dir, C.cleaned(F.col("text")))


#: Notices that a task cleans, for about ten seconds.
ROWS_A_TASK = 20_000


def notices(spark, sf_dir):
    """Disclosures in Japanese, made of the orders: id and text."""
    c = lambda e: e.cast("string")
    key, total = F.col("o_orderkey"), F.format_number(F.floor("o_totalprice"), 0)
    parts = [
        F.lit("株式会社Ａ１２"), c(key), F.lit(" 証券コード："), c(key % 9000 + 1000), F.lit(" 業績予想の修正に関するお知らせ 当社は、"), F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月期の業績について、売上高は "),
        total, F.lit(" 百万円（前年同期比△"), c(key % 40), F.lit("％）となる見込みです。発表は令和"), c(key % 9 + 1), F.lit("年"), c(key % 12 + 1), F.lit("月"), c(key % 28 + 1), F.lit("日（月）午後3時30分です。"),
        F.lit("対象期間は"), c(key % 12 + 1), F.lit("～12月で、"), F.year("o_orderdate"), F.lit("年度の第1四半期は1Qと呼びます。詳細は https://ir.example.jp/"), c(key), F.lit(" をご覧ください。"),
        F.lit("お問い合わせ ir"), c(key), F.lit("@example.co.jp 電話 03-1234-"), F.lpad(c(key % 10000), 4, "0"), F.lit(" 以上"),
    ]
    orders = entities.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    # rows of a few bytes make texts that take long: they're dealt by number, however few files and row groups hold them
    dealt = orders.repartition(orders.count() // ROWS_A_TASK + 1, "o_orderkey")
    return dealt.select(key.alias("id"), F.concat(*(p.cast("string") for p in parts)).alias("text"))


@query()
def clean_notices(spark, sf_dir):
    """The whole chain, and the sentences that remain as a body, over Japanese disclosures."""
    both = C.let(C.cleaned(F.col("text")), lambda text: F.struct(text.alias("text"), C.body(text).alias("body")))  # one chain for both columns
    return notices(spark, sf_dir).select("id", both.alias("both")).select("id", "both.text", "both.body")


@query(sql("trim(regexp_replace(text, '[\\s]+', ' ', 'g'))"))
def collapse_ws(spark, sf_dir):
    return text(spark, sf_dir, F.trim(F.regexp_replace("text", SPACES, " ")))


@query("SELECT doc_id, coalesce(regexp_matches(text, '[\\x00-\\x1F\\x7F]') OR NOT regexp_matches(text, '[a-m]'), true) AS broken FROM documents")
def broken_text(spark, sf_dir):
    """Texts with control characters or without a letter of the script, here a to m."""
    return docs(spark, sf_dir).select("doc_id", C.broken(F.col("text"), "a-m").alias("broken"))


@query(r"SELECT doc_id, regexp_matches(text, '\b1\s+2\s+3\s+4\s+5\s+6\s+7\s+8\s+9\s+10\s+11\s+12\b') AS calendar FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' 1 2 3 4 5 6 7 8 9 10 11 12' ELSE text END AS text FROM documents)")
def calendar_rows(spark, sf_dir):
    with_days = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" 1 2 3 4 5 6 7 8 9 10 11 12"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", with_days.rlike(C.CALENDAR).alias("calendar"))


@query()
def sentence_keep(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", C.sentences(F.col("text")).alias("sentences"))
    return found.select("doc_id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("text"))


@query()
def keyword_notice(spark, sf_dir):
    return text(spark, sf_dir, C.notice(F.replace(F.col("text"), F.lit("."), F.lit("。")), ["the", "der", "que"]))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(the)', ' `\1` ', 'g'), '(?i)(und)', ' `\1` ', 'g') AS text FROM documents")
def highlight(spark, sf_dir):
    return text(spark, sf_dir, C.highlighted(F.col("text"), ["the", "und"]))


@query("SELECT doc_id, '**' || coalesce(lang, 'N/A') || '** ' || coalesce(source, 'N/A') || chr(10) || substr(text, 1, 30) AS payload FROM documents WHERE regexp_matches(text, '(?i)the')")
def alert_payload(spark, sf_dir):
    """The message of each document with a keyword."""
    na = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    message = F.concat(F.lit("**"), na("lang"), F.lit("** "), na("source"), F.lit("\n"), F.substring("text", 1, 30))
    return docs(spark, sf_dir).where(F.col("text").rlike("(?i)the")).select("doc_id", message.alias("payload"))


@query("""SELECT o_orderkey AS id, '*' || coalesce(strftime(o_orderdate, '%Y-%m-%d'), 'N/A') || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%H:%M') END || '*  ' || chr(10) || '*code:* `' || coalesce(o_custkey::VARCHAR, 'N/A') || '`  ' || chr(10) || '---  ' || chr(10) || '*社名:* ' || coalesce(c_name, 'N/A') || '  ' || chr(10) || coalesce(regexp_replace(text, '(?i)(the)', ' `\\1` ', 'g'), '') AS message
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 > 0) ON c_custkey = o_custkey LEFT JOIN documents ON doc_id = o_orderkey""")
def alert_message(spark, sf_dir):
    """The whole message of a disclosure: date, time, code, name and text with its keywords marked; what is missing reads N/A."""
    orders = entities.table(spark, sf_dir, "orders")
    names = entities.table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    texts = docs(spark, sf_dir).select(F.col("doc_id").alias("o_orderkey"), "text")
    time = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "HH:mm"))
    message = C.alert_message(F.date_format("o_orderdate", "yyyy-MM-dd"), time, F.col("o_custkey").cast("string"), F.col("name"), C.highlighted(F.col("text"), ["the"]))
    return orders.join(names, "o_custkey", "left").join(texts, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), message.alias("message"))


@query("SELECT doc_id, '{\"Link\":\"' || source || '/' || doc_id || '\",\"Summarize\":\"' || coalesce(n_chars::VARCHAR, '') || '\"}' AS line FROM documents")
def ndjson_rows(spark, sf_dir):
    record = F.struct(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("Link"), F.coalesce(F.col("n_chars").cast("string"), F.lit("")).alias("Summarize"))
    return docs(spark, sf_dir).select("doc_id", F.to_json(record).alias("line"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS html FROM pages""")
def html_escape(spark, sf_dir):
    return entities.table(spark, sf_dir, "pages").select("page_id", C.escaped(F.col("html")).alias("html"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\s]+', '', 'g') AS text FROM pages")
def strip_tags(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"[\s]+", "")
    return entities.table(spark, sf_dir, "pages").select("page_id", plain.alias("text"))


@query(r"SELECT page_id, (i - 1)::BIGINT AS place, links[i] AS link, labels[i] AS label FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) links, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) labels, unnest(range(1, len(links) + 1)) i FROM pages)")
def links_from_pages(spark, sf_dir):
    return pages.links(entities.table(spark, sf_dir, "pages"))


LINKS_SQL = r"SELECT page_id, (i - 1)::BIGINT AS place, links[i] AS link, labels[i] AS label FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1) links, regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2) labels, unnest(range(1, len(links) + 1)) i FROM pages)"


@query(f"WITH l AS ({LINKS_SQL}), n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS page FROM pages) SELECT page, place, trim(label) AS title, link AS text, '09:30' AS time FROM l JOIN n USING (page_id)")
def numbered_feeds(spark, sf_dir):
    """Articles of numbered JSONP feeds, one for the links of each page, written as files and read by the page source until the first number that is missing."""
    table, at = entities.table(spark, sf_dir, "pages"), shared_dir(spark, "feeds")
    article = F.struct(F.col("label").alias("title"), F.col("link").alias("text"), F.struct(F.lit("list").alias("name")).alias("provider"), F.struct(F.lit("2024-05-01T09:30:00+09:00").alias("time_iso_8601")).alias("updated_at"))
    listed = pages.links(table).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", article.alias("a")))), lambda x: x["a"]).alias("articles"))
    numbered = paging.numbered(table.select("page_id"), ["page_id"]).join(listed, "page_id", "left")
    body = F.to_json(F.struct(F.coalesce("articles", F.from_json(F.lit("[]"), "array<struct<title: string, text: string, provider: struct<name: string>, updated_at: struct<time_iso_8601: string>>>")).alias("articles")))
    chain.write_pages(numbered.select((F.col("number") + 1).cast("string").alias("cursor"), F.concat(F.lit("addReleaseList("), body, F.lit(");")).alias("html")), at)
    found = chain.read_chain(spark, at, kind="numbered").select("page", F.posexplode(pages.articles(F.col("html"))).alias("place", "a"))
    return found.select("page", F.col("place").cast("bigint").alias("place"), F.col("a.title").alias("title"), F.col("a.text").alias("text"), F.col("a.time").alias("time"))


@query("SELECT s_suppkey AS code, translate(replace(replace(replace(s_name, '株式会社', ''), 'HD', ''), '・', ''), '" + C.NARROW + "', '" + C.WIDE + "') AS name FROM (SELECT s_suppkey, replace(s_name, '#', '') s_name FROM supplier)")
def company_normalise(spark, sf_dir):
    return entities.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), C.company(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))).alias("name"))


@query("SELECT o_orderkey AS id, CASE WHEN length(c) = 5 THEN rtrim(c, '0') ELSE c END AS code FROM (SELECT o_orderkey, (o_orderkey * 10)::VARCHAR c FROM orders)")
def code_zero_strip(spark, sf_dir):
    return entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), C.short_code((F.col("o_orderkey") * 10).cast("string")).alias("code"))


@query(r"SELECT o_orderkey AS id, regexp_replace(t, ':\S+\.pdf', '') AS title, 'https://x/' || replace(nullif(regexp_extract(t, ':\S+\.pdf', 0), ''), ':', '') AS url FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE o_orderpriority || ':a/' || o_orderkey || '.pdf' END t FROM orders)")
def title_url_split(spark, sf_dir):
    plain = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(":a/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    title, url = C.title_and_url(F.col("t"), "https://x/")
    return entities.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), plain.alias("t")).select("id", title.alias("title"), url.alias("url"))


@query("SELECT conv_id, '{''table'': ' || string_agg('「' || role || ' | ' || CASE WHEN turn % 3 = 0 THEN '*' ELSE '（' || turn || '） x' END || '」', ' ' ORDER BY turn) || '}' AS text FROM conversations GROUP BY conv_id")
def pdf_table_render(spark, sf_dir):
    """Each conversation as a table: a row per turn of its role and a numbered cell, empty at every third."""
    own = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("x （"), F.col("turn").cast("string"), F.lit("）")))
    rows = entities.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(F.col("role"), own).alias("cells")))).alias("r"))
    return rows.select("conv_id", C.table_text(F.transform("r", lambda x: x["cells"])).alias("text"))


@query("SELECT turn, count(*) AS n, count_if(ok)::BIGINT AS ok FROM (SELECT turn, try_strptime('2024年' || (turn % 14) || '月' || (conv_id % 31) || '日 9時05分', '%Y年%m月%d日 %H時%M分') IS NOT NULL ok FROM conversations) GROUP BY turn")
def japanese_dates(spark, sf_dir):
    """Date-times in Japanese notation; those that don't exist are null."""
    stamp = F.concat(F.lit("2024年"), (F.col("turn") % 14).cast("string"), F.lit("月"), (F.col("conv_id") % 31).cast("string"), F.lit("日 9時05分"))
    parsed = F.try_to_timestamp(stamp, F.lit("yyyy年M月d日 H時mm分"))
    return entities.table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.count_if(parsed.isNotNull()).alias("ok"))
