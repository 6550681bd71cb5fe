"""Cleaning and masking of disclosure texts: an ordered chain of column expressions.

Order matters: a tag that an earlier step writes hides its text from later
patterns. Patterns are Java regular expressions.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words and characters that results depend on ---

WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
NOISE = ["copyright", "©", "section", "Takasago International Corporation", "(C)DyDoGroupHoldings.", "Rentracks.", "WATTMANN.CO.,LTD.", "all rights reserved", "SANKO TECHNO GROUP", "FUJISOFT INCORPORATED", "Science Arts Inc."]
IMPORTANT = ["株主総会", "辞任", "異動", "人事", "委員会", "訴状", "値上げ"]
ALERTS = ["業績予想", "上場廃止", "世界初", "史上初", "業界初", "上方修正", "優待新設", "過去最高", "増配", "自社株買い", "優待拡充", "日本初"]
LOW_PRIORITY = ["目次", "会社概要", "沿革", "軌跡"]
HEADERS = [r"お知らせ(?:」)?(?:の一部変更について|の一部訂正について)?", "ついてのお知らせ", "ついて", "お知らせ", "OVERVIEW", "業績サマリー Point", "百万円未満切捨て", r"証券コード(?:\:\s?|[ 　])[0-9]{4}"]
CONTACTS = ["■本件に関するお問い合わせ先", "(?:【)?本件に関する(?:お)?問合せ(?:】)?", "お問い合わせ", "本資料に関するお問合せ先"]
UNITS = ["百万円", "千万円", "億円", "百万", "万円", "千円", "万人", "円", "株", "%", "％", "㎡", "件", "号", "倍", "社", "人ポイント", "pt", "pp"]
NOT_UNITS = ["株主", "株式", "株当たり", "株数", "株価", "株元", "株券", "社長", "社名", "社外", "社員", "社数", "社宅", "社内", "社歴", "人件費", "人材", "人口", "人数", "人員", "人月", "人時", "人手", "人物", "件数", "件名", "事件", "案件", "倍率", "倍増", "倍減", "ポイント還元", "ポイント制", "ポイント数", "％表示", "％比率", "％変動"]
EXTENSIONS = {"の末日": "EXT", "末日": "EXT", "末": "EXT", "下期": "TERM_EXT", "上期": "TERM_EXT", "1Q": "QUARTER1_EXT", "2Q": "QUARTER2_EXT", "3Q": "QUARTER3_EXT", "4Q": "QUARTER4_EXT", "第1四半期": "QUARTER1_EXT", "第2四半期": "QUARTER2_EXT", "第3四半期": "QUARTER3_EXT", "第4四半期": "QUARTER4_EXT", "中間期": "HALF_EXT", "通期": "ALL_EXT"}

# --- fixed values: the parts that patterns are made of ---

ERA = "(?:令和|平成|昭和|大正|明治)"
YEAR = "(?:18[0-9]{2}|19[0-9]{2}|20[0-3][0-9]|2040)"
MONTH = "(?:1[0-2]|0?[1-9])"
DAY = "(?:3[01]|[12][0-9]|0?[1-9])"
GAP, GAPS = "[ 　]?", "[ 　]*"
TILDE = "[-～〜~]"
NO_SIGN = r"(?<![.,+\-△▲])"
NO_SIGN_OR_DIGIT = r"(?<![.,+\-△▲0-9])"
#: What a match begins with: looked at first, as most characters begin none.
FROM_DIGIT, FROM_DATE = "(?=(?-i:[0-9]))", "(?=(?-i:[0-9令平昭大明]))"
NO_DAY_AFTER = r"(?!\s*\d{1,2}\s*日)"
WORD = r"\w\-._~:/?#\[\]@!$&'()*+,;=%"

INVISIBLE = "[\\u2000-\\u200F\\uFE0F\\u2028\\u2029\\u2060]+"
URL = f"(?iuU)(?:https?://|www\\.)[{WORD}]+"
PHONE = r"(?iuU)(?=[（(0]|\s+0)(?<![.,+\-△▲\d])([（(]?\s*0\d{1,4}\s*[）)]?[-ー－−–（）\s]*\d{2,4}[-ー－−–（）\s]*\d{3,4})(?!\d)"
MAIL = r"(?iu)(?<![a-zA-Z0-9])[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
ESTIMATE = rf"(?iuU){FROM_DIGIT}{NO_SIGN}{YEAR}(?:年(?:度)?)?[\(（]\s*(?:見込み|見通し|予測)\s*[\)）]"
FISCAL = f"(?iu){FROM_DATE}{NO_SIGN}(?:" + "|".join(
    [f"{ERA}{GAP}[0-9]{{1,2}}{GAP}年{GAP}{MONTH}{GAP}月期", f"{YEAR}/{MONTH}期", f"[0-9]{{2}}/{MONTH}期", f"{YEAR}{GAP}年{GAP}{MONTH}{GAP}月期", f"[0-9]{{2}}{GAP}年{GAP}{MONTH}{GAP}月期", f"{MONTH}{GAP}月期"]
) + ")"
TERM = f"(?iuU){FROM_DIGIT}{NO_SIGN}(?:" + "|".join(
    [
        r"(?:18[0-9]{2}|19[0-9]{2}|20[0-2]\d)[　\s\-ー〜～]?(?:18[0-9]{2}|19[0-9]{2}|20[0-2]\d)年(?:度)?",
        f"{YEAR}{GAP}年{GAP}{MONTH}{GAP}{TILDE}{GAP}{MONTH}{GAP}月{NO_DAY_AFTER}",
        f"{YEAR}[/／－]{GAP}{MONTH}{GAP}{TILDE}{GAP}{MONTH}{NO_DAY_AFTER}",
        f"{MONTH}{GAP}{TILDE}{GAP}{MONTH}{GAP}月{NO_DAY_AFTER}",
        f"{YEAR}{GAP}年{GAP}{MONTH}{GAP}月{GAP}{TILDE}{GAP}{MONTH}{GAP}月{NO_DAY_AFTER}",
        f"{YEAR}{GAP}{TILDE}{GAP}{YEAR}",
    ]
) + ")"
DATE = f"(?iuU)(?=(?-i:[0-9０-９令平昭大明])){NO_SIGN}(?:" + "|".join(
    [
        f"{ERA}{GAPS}[0-9]{{1,2}}{GAPS}年{GAPS}{MONTH}{GAPS}月{GAPS}{DAY}{GAPS}日",
        f"{ERA}{GAPS}[0-9]{{1,2}}{GAPS}年{GAPS}{MONTH}{GAPS}月",
        f"{YEAR}{GAP}年{GAP}{MONTH}{GAP}月{GAP}(?:0?[1-9]|[12][0-9]|3[01]){GAP}日",
        rf"{YEAR}[\/\-\.]{MONTH}[\/\-\.]{DAY}",
        f"{MONTH}{GAP}月{GAP}(?:0?[1-9]|[12][0-9]|3[01]){GAP}日",
        f"{YEAR}{GAP}年{GAP}{MONTH}{GAP}月",
        # from U+002F to U+FF0F and the wide hyphen: nearly any character may part year and month
        rf"(?<!\d){YEAR}[/-／－]{MONTH}(?!\d)",
        f"(?:[0-9０-９]{{2}}){GAP}年{GAP}{MONTH}{GAP}月",
        rf"(?:[0-9]{{2}}){GAPS}年{GAPS}{MONTH}(?=[ 　月.,)）\n]|$)",
    ]
) + ")"
YEAR_TAG = f"(?iu)(?=(?-i:[0-9Ff])){NO_SIGN_OR_DIGIT}(?:{YEAR}年(?:度)?|FY{YEAR}|FY(?:[0-9]{{2}}))(?![月期0-9０-９])"
MONTH_TAG = f"(?iu){FROM_DIGIT}{NO_SIGN_OR_DIGIT}{MONTH}{GAPS}月(?![日0-9０-９])"
DAY_TAG = f"(?iu){FROM_DIGIT}{NO_SIGN_OR_DIGIT}(?:0?[1-9]|[12][0-9]|3[01]){GAPS}日(?=[ 　（(])"
DOT_BEFORE_DATE = rf"(?iuU)(?<=\d)\.(?=(?:[0-9]{{2}}|19[0-9]{{2}}|20[0-3][0-9]|2040)[ 　]*年|{MONTH}[ 　]*月|{DAY}[ 　]*日)"
SPACE_BEFORE = rf"(?iuU)(?<={YEAR})\s+(?=年)|[ 　]+(?=(?:の末日|末日|末))"
DELETED = r"(?iuU)(?=[（(午0-9.。,、]|\s+[0-9])(?:[（(](?:月曜日|火曜日|水曜日|木曜日|金曜日|土曜日|日曜日|月|火|水|木|金|土|日)[）)]|(?:午前|午後)?\s*(?:[0-9]|1[0-9]|2[0-4])\s*時\s*(?:(?:[0-9]|[1-5][0-9]|60)\s*分)?|[.。,、]{2,}|^（代表）)"
CALENDAR = r"(?U)\b" + r"\s+".join(map(str, range(1, 13))) + r"\b"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def held(c: Column, words: list[str], use) -> Column:
    """use(c) of a text that holds one of the words, else the text: for steps that change no other."""
    return let(c, lambda c: F.when(functools.reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words)), use(c)).otherwise(c))


def replaced(c: Column, words: list[str], pattern: str, by: str) -> Column:
    """regexp_replace() for a pattern that matches only where one of the words is."""
    return held(c, words, lambda c: F.regexp_replace(c, pattern, by))


def alternatives(words: list[str]) -> str:
    return "|".join(f"\\Q{w}\\E" for w in words)


def without_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def narrowed(c: Column) -> Column:
    return let(c, lambda c: F.when(c.rlike("[Ａ-Ｚａ-ｚ０-９]"), F.translate(c, WIDE, NARROW)).otherwise(c))


def without_header(c: Column, reach: int = 300, phone_reach: int = 200) -> Column:
    """Cut through the first header phrase that starts within reach; else through the first telephone number of ten digits within phone_reach.

    The cut needs the phrase on the text's first line; one behind a line end is found but nothing is cut.
    """
    return let(c, lambda c: _without_header(c, reach, phone_reach))


def _without_header(c: Column, reach: int, phone_reach: int) -> Column:
    phrase = "(?s)^(.{0," + str(reach) + "}?)(" + "|".join(HEADERS) + ")"
    first_line = F.regexp_replace(c, "^[^\n]*?(?:" + "|".join(HEADERS) + ")", "")
    numbers = F.filter(F.regexp_extract_all(c, F.lit(PHONE), 1), lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")) >= 10)
    behind = lambda number: F.substring(c, F.instr(c, number) + F.length(number), F.length(c))
    by_phone = let(F.get(numbers, F.lit(0)), lambda number: F.when(number.isNotNull() & (F.instr(c, number) - 1 < phone_reach), behind(number)).otherwise(c))
    return F.when(c.rlike(phrase), first_line).otherwise(by_phone)


def without_footer(c: Column, reach: int = 200) -> Column:
    """Cut before the last closing word, then before the last contact phrase, if either starts within reach of the end."""
    def cut(phrase: str, c: Column) -> Column:
        before = F.regexp_extract(c, f"(?s)^(.*)(?:{phrase})", 1)
        return F.when(c.rlike(phrase), let(before, lambda b: F.when(F.length(b) >= F.length(c) - reach, b).otherwise(c))).otherwise(c)

    c = let(c, lambda c: cut(r"以\s*上", c))
    return let(c, lambda c: cut("|".join(CONTACTS), c))


def without_noise(c: Column) -> Column:
    return F.regexp_replace(c, f"(?iu){alternatives(NOISE)}", "。")


def split_years(c: Column, least: int = 3) -> Column:
    """Runs of glued years, unless they begin a line, become a tag for each year."""
    years = f"(?:19[89][0-9]|20[0-2][0-9]){{{least},}}"
    parts = F.split(F.regexp_replace(c, f"(?=[12])(?<=[^\\n])({years})", " \u0001$1\u0002"), "\u0001")
    run = lambda p: F.substring_index(p, "\u0002", 1)
    tags = lambda p: F.array_join(F.array_repeat(F.lit("<YEAR>"), (F.length(run(p)) / 4).cast("int")), " ")
    behind = lambda parts: F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(tags(p), F.substring(p, F.length(run(p)) + 2, F.length(p))))
    return let(parts, lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(behind(parts), "")))


def joined_units(c: Column) -> Column:
    """A number and its unit are joined by _, unless what follows makes the unit part of another word.

    An exception is told by what is left of it after as many characters as the unit has, whatever the unit.
    """
    each = []
    for n in sorted({len(u) for u in UNITS}, reverse=True):
        units = [re.escape(u) + ("(?!円)" if u == "百万" else "") for u in UNITS if len(u) == n]
        rests = sorted({re.escape(e[n:]) for e in NOT_UNITS if e[n:]})
        each.append(f"(?:{'|'.join(units)})" + (f"(?!{'|'.join(rests)})" if rests else ""))
    return F.regexp_replace(c, rf"(?U)(\d+(?:[,.]\d+)?)[\s\u3000]*({'|'.join(each)})", "$1_$2")


def signed_numbers(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[＋+](\d+)", "+$1"), r"(?U)[△▲−ー－-](\d+)", "-$1")


def extended_tags(c: Column) -> Column:
    """A period's tag takes in the word behind it."""
    by_name: dict[str, list[str]] = {}
    for word, name in EXTENSIONS.items():  # no word begins with a later one of another name
        by_name.setdefault(name, []).append(word)

    def taken(c: Column) -> Column:
        for name, words in by_name.items():
            c = replaced(c, words, f"<((?i:ESTIMATE|FISCAL|PERIOD|TERM|DATE|YEAR|MONTH|DAY))>(?:{alternatives(words)})", f"<$1_{name}>")
        return F.regexp_replace(c, "(?i)<(ESTIMATE|FISCAL|PERIOD|TERM|DATE|YEAR|MONTH|DAY)>[1-4]q", "<$1_DEFAULT>")

    return held(c, ["<"], taken)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cleaned(c: Column) -> Column:
    """The whole chain."""
    c = without_noise(without_footer(without_header(narrowed(without_invisible(c)))))
    c = replaced(replaced(c, ["年", "月", "日"], DOT_BEFORE_DATE, ".#break#"), ["年", "末"], SPACE_BEFORE, "")
    c = replaced(F.regexp_replace(F.regexp_replace(c, URL, "<URL>"), PHONE, "<PHONE>"), ["@"], MAIL, "<MAIL>")
    c = split_years(replaced(c, ["見込み", "見通し", "予測"], ESTIMATE, "<ESTIMATE>"))
    c = F.regexp_replace(F.regexp_replace(replaced(c, ["期"], FISCAL, "<FISCAL>"), TERM, "<TERM>"), DATE, "<DATE>")
    c = replaced(replaced(F.regexp_replace(c, YEAR_TAG, "<YEAR>"), ["月"], MONTH_TAG, "<MONTH>"), ["日"], DAY_TAG, "<DAY>")
    c = F.regexp_replace(extended_tags(signed_numbers(joined_units(c))), "(?i)(?<=[0-9])(?=[1-4]Q)", " ")
    c = F.replace(c, F.lit(".#break#"), F.lit("."))
    return trimmed(F.regexp_replace(F.regexp_replace(c, "[\\ue000-\\uf8ff]", "・"), DELETED, ""))


# --- sentences, notices and rendering ---


#: A sentence: characters and brackets with all they hold up to the next closing one, or to the text's end; then a mark, if one follows.
SENTENCE = r"(?:[^（(。！!？?]++|[（(][^）)]*+(?:[）)]|\z))++[。！!？?]?"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def sentences(c: Column, least: int = 21) -> Column:
    """Sentences of at least `least` characters once stripped. A full stop in brackets ends none; any closing bracket ends all brackets."""
    return let(F.coalesce(c, F.lit("")), lambda text: _sentences(text, least))


def _sentences(text: Column, least: int) -> Column:
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    if least > 1:  # without brackets a sentence ends behind its mark; further marks are parts of one character
        parts = F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit("（")), parts).otherwise(F.split(text, "(?<=[。！!？?])"))
    found = F.transform(parts, lambda s: F.trim(s, F.lit(BLANKS)))
    return F.filter(found, lambda s: F.length(s) >= least)


def holds_any(c: Column, words: list[str]) -> Column:
    return c.rlike(alternatives(words))


def body(c: Column) -> Column:
    """The sentences of a cleaned text without low-priority words or calendars, joined."""
    return F.array_join(F.filter(sentences(c), lambda s: ~holds_any(s, LOW_PRIORITY) & ~s.rlike(CALENDAR)), "")


def notice(c: Column, words: list[str], most: int = 1000) -> Column:
    """The sentences of a text that hold one of the words, joined, up to `most` characters. A text without any isn't cut up."""
    held = F.substring(F.array_join(F.filter(sentences(c), lambda s: holds_any(s, words)), ""), 1, most)
    return F.when(F.coalesce(holds_any(c, words), F.lit(False)), held).otherwise(F.lit(""))


def highlighted(c: Column, words: list[str]) -> Column:
    for w in words:
        c = F.regexp_replace(c, f"(?iu)(\\Q{w}\\E)", " `$1` ")
    return c


def broken(c: Column, script: str = r"\u3040-\u30ff\u4e00-\u9fff") -> Column:
    """Whether a text has control or zero-width characters or others of no use, or none of the script's letters."""
    odd = "[\\u0000-\\u001f\\u007f\\u0500-\\u05ff\\u200b-\\u200d\\u2060-\\u2062\\u0886]"
    return F.coalesce(c.rlike(odd) | ~c.rlike(f"[{script}]"), F.lit(True))


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"(?U)\s+", "")


def company(c: Column) -> Column:
    """A company's name as it is compared: legal forms and dots off, wide letters, no white space."""
    for w in ("株式会社", "HD", "・"):
        c = F.replace(c, F.lit(w), F.lit(""))
    return F.regexp_replace(F.translate(c, NARROW, WIDE), r"(?U)\s+", "")


def short_code(c: Column) -> Column:
    """A code of five characters loses all its last zeros."""
    return F.when(F.length(c) == 5, F.regexp_replace(c, "0+$", "")).otherwise(c)


def title_and_url(c: Column, base: str) -> tuple[Column, Column]:
    """The title and URL of 'title:path.pdf'; without a path the URL is null."""
    path = F.nullif(F.regexp_extract(c, r":\S+\.pdf", 0), F.lit(""))
    return F.regexp_replace(c, r":\S+\.pdf", ""), F.concat(F.lit(base), F.replace(path, F.lit(":"), F.lit("")))


def escaped(c: Column) -> Column:
    for plain, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(plain), F.lit(named))
    return c


def cell(c: Column) -> Column:
    """A table cell on one line, a bracketed number first; * if empty."""
    one = F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    number = F.regexp_extract(one, "（[0-9]+）", 0)
    moved = F.concat(number, F.lit(" "), F.trim(F.replace(one, number, F.lit(""))))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("*")).when(number != "", moved).otherwise(one)


def table_text(rows: Column) -> Column:
    """An array of rows of cells as text."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("「"), F.array_join(F.transform(r, cell), " | "), F.lit("」")))
    empty = F.coalesce(F.size(rows) < 1, F.lit(True)) | F.coalesce(F.size(F.get(rows, F.lit(0))) < 1, F.lit(True))
    return F.when(empty, F.lit("{'table': 『*』}")).otherwise(F.concat(F.lit("{'table': "), F.array_join(lines, " "), F.lit("}")))


def without_table_text(text: Column, rows: Column) -> Column:
    """A text without what a table (an array of rows of cells) repeats of it: from the first ten characters of its first row to the last ten of its last row, as short as can be."""
    line = lambda r: F.array_join(F.filter(r, lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    first, last = F.substring(line(F.get(rows, F.lit(0))), 1, 10), F.right(line(F.element_at(rows, -1)), F.lit(10))
    pattern = F.concat(F.lit("(?s)"), quoted(first), F.lit(".*?"), quoted(last))
    return F.when((F.coalesce(text, F.lit("")) == "") | F.coalesce(F.size(rows) < 1, F.lit(True)), text).otherwise(trimmed(F.regexp_replace(text, pattern, F.lit(""))))


def document_text(page_text: Column, tables: Column) -> Column:
    """A page's text with its tables, an array of (top, text before, rows), from top to bottom: before each table the text above it without what the table repeats, and at last the page's own."""
    placed = F.array_sort(tables, lambda a, b: F.when(a["top"] < b["top"], -1).when(a["top"] > b["top"], 1).otherwise(0))
    part = lambda t: F.concat(F.when(F.coalesce(t["before"], F.lit("")) == "", F.lit("")).otherwise(F.concat(without_table_text(t["before"], t["rows"]), F.lit("\n\n"))), table_text(t["rows"]))
    below = let(placed, lambda p: F.when(F.size(p) > 0, without_table_text(page_text, F.element_at(p, -1)["rows"])).otherwise(page_text))
    return trimmed(F.array_join(F.concat(F.transform(placed, part), F.array(F.coalesce(below, F.lit("")))), "\n\n"))


#: What stands for a document that couldn't be fetched, has no text, or failed.
NOT_FETCHED, NO_TEXT, FAILED = "Failed to download PDF", "No readable text found", "★Error 想定外のエラーが発生しました: "


def or_sentinel(text: Column, fetched: Column, error: Column) -> Column:
    """A document's text, or what tells why there is none."""
    return F.when(~F.coalesce(fetched, F.lit(False)), F.lit(NOT_FETCHED)).when(error.isNotNull(), F.concat(F.lit(FAILED), error)).when(F.coalesce(text, F.lit("")) == "", F.lit(NO_TEXT)).otherwise(text)


def alert_message(date: Column, time: Column, code: Column, name: Column, text: Column) -> Column:
    """The message about a disclosure; what is missing reads N/A, a missing text is empty."""
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    return F.concat(F.lit("*"), na(date), F.lit(" "), na(time), F.lit("*  \n*code:* `"), na(code), F.lit("`  \n---  \n*社名:* "), na(name), F.lit("  \n"), F.coalesce(text, F.lit("")))
