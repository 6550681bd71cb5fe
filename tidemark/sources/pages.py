"""Lists scraped from pages and JSON feeds, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import until_empty_page

LINK = '<a href="([^"]*)">([^<]*)</a>'
#: The wrapper of a JSONP feed.
JSONP = r"(?s)^\s*[\w.]+\((.*)\)\s*;?\s*$"
ARTICLES = "struct<articles: array<struct<title: string, text: string, provider: struct<name: string>, updated_at: struct<time_iso_8601: string>>>>"


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, link and label of every link."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("link"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("place", "x")).select("page_id", F.col("place").cast("bigint").alias("place"), F.col("x.link").alias("link"), F.col("x.label").alias("label"))


def cells(html: Column) -> Column:
    """The cells of each table row with at least one; a cell with a link is 'text:href'."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    href = lambda c: F.regexp_extract(c, r"(?i)href\s*=\s*[\"']([^\"']*)", 1)
    cell = lambda c: F.when(href(c) != "", F.concat(plain(c), F.lit(":"), href(c))).otherwise(plain(c))
    table = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), cell))
    return F.filter(table, lambda r: F.size(r) > 0)


def articles(feed: Column) -> Column:
    """The articles of a JSONP feed as an array of (time, name, title, text); null if it can't be read."""
    body = F.from_json(F.regexp_extract(feed, JSONP, 1), ARTICLES)["articles"]
    return F.transform(
        body, lambda a: F.struct(F.substring(a["updated_at"]["time_iso_8601"], 12, 5).alias("time"), F.coalesce(F.trim(a["provider"]["name"]), F.lit("")).alias("name"), F.trim(a["title"]).alias("title"), a["text"].alias("text"))
    )


# --- chained lists (chain.py follows them) and detail pages ---

#: Cells of these classes keep their text alone, the row that names the next page, and the labels of a detail page.
PLAIN_CELLS = ["ct", "wmx300"]
NEXT_ROW = r"(?is)<tr\b(?=[^>]*\bid\s*=\s*[\"']?loading\b)[^>]*\bdata-nx\s*=\s*[\"']([^\"']*)"
WHEN, MATERIAL = "【日時】", "【資料】"

def plain(c: Column) -> Column:
    """The text of a piece of HTML: tags and white space at its ends off, entities of markup resolved."""
    text = F.regexp_replace(c, "<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, name, mark)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def list_rows(html: Column, least: int = 3) -> Column:
    """The rows of a page's list, each an array of at least `least` cells. A cell with a link is 'text=>href', unless its class keeps it plain."""
    table = F.regexp_extract(html, r"(?is)<table\b(?=[^>]*\bclass\s*=\s*[\"']?[^\"'>]*\bcs\b)[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    tag = lambda c: F.regexp_extract(c, "(?is)^<td[^>]*>", 0)
    link = lambda c: F.regexp_extract(c, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", 1)
    named = lambda c: F.regexp_extract(c, r"(?is)<a\b[^>]*>(.*?)</a>", 1)
    bare = lambda c: tag(c).rlike(rf"(?i)\bclass\s*=\s*[\"']?[^\"'>]*\b(?:{'|'.join(PLAIN_CELLS)})\b")
    cell = lambda c: F.when((link(c) != "") & ~bare(c), F.concat(plain(named(c)), F.lit("=>"), link(c))).otherwise(plain(c))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<td[^>]*>.*?</td>"), F.lit(0)), cell))
    return F.filter(cells, lambda r: F.size(r) >= least)


def title_and_path(c: Column, base: str) -> tuple[Column, Column]:
    """The title and URL of 'title=>/path'; without a path the URL is null."""
    path = F.nullif(F.regexp_extract(c, r"=>(\S+)", 1), F.lit(""))
    return F.regexp_replace(c, r"=>\S+", ""), F.concat(F.lit(base), F.regexp_replace(path, "^/", ""))


def detail(html: Column) -> tuple[Column, Column]:
    """The time and the PDF's link of a detail page; null where they are missing or can't be read."""
    info = F.regexp_extract(html, r"(?is)<dl\b(?=[^>]*\bid\s*=\s*[\"']?info\b)[^>]*>(.*?)</dl>", 1)
    after = lambda label: F.regexp_extract(info, rf"(?is)<dt[^>]*>\s*{label}\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1)
    stamp = F.try_to_timestamp(plain(after(WHEN)), F.lit("yyyy年M月d日 H時m分"))
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.nullif(F.regexp_extract(after(MATERIAL), r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit(""))


# --- quotes from pages ---

QUOTE = ("open", "high", "low", "close", "volume")


def number(c: Column) -> Column:
    """A number that may have thousands separators; other text is null."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def with_constants(bars: DataFrame) -> DataFrame:
    """Bars with dividends and splits, which pages don't tell: 0."""
    return bars.withColumns({"dividends": F.lit(0.0), "splits": F.lit(0.0)})


def quotes(pages: DataFrame, most: int = 19) -> DataFrame:
    """code, date and bars of pages (code, page, html), page from 1: those before a code's first page without rows, and `most` at most. A row is a date and five numbers; rows that tell of a split have fewer cells."""
    rows = F.regexp_extract_all("html", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.where(F.col("page") <= most).select("code", "page", F.explode_outer(rows).alias("row"))
    parts = each.select("code", "page", plain(F.regexp_extract("row", "(?is)<th[^>]*>(.*?)</th>", 1)).alias("day"), F.transform(F.regexp_extract_all("row", F.lit("(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain).alias("cells"))
    day = F.to_date(F.try_to_timestamp("day", F.lit("yyyy年M月d日")))
    held = F.coalesce((F.size("cells") == len(QUOTE)) & day.isNotNull(), F.lit(False))
    kept = until_empty_page(parts.withColumn("held", held), F.col("held"), ["code"])
    return with_constants(kept.select("code", day.alias("date"), *(number(F.get("cells", F.lit(k))).alias(c) for k, c in enumerate(QUOTE))))
