"""The cleaning chain over Japanese texts: every tag by hand, and the whole chain against plain Python on made-up texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.plans import documents
from tidemark.plans.registry import QUERIES

MARKS = re.compile("[（(）)。！!？?]")


def split_sentences(text, least=21):
    found, start, inside = [], 0, False
    for m in MARKS.finditer(text or ""):
        if m[0] in "（(":
            inside = True
        elif m[0] in "）)":
            inside = False
        elif not inside:
            found.append(text[start : m.end()])
            start = m.end()
    found.append((text or "")[start:])
    return [s for s in map(str.strip, found) if len(s) >= least]


def test_sentences(spark):
    long = "これは二十文字より長いはずの文でありますから残ります。"
    rng = random.Random(8)
    texts = [None, "", long + "短い。" + long, "（括弧の中。句点）" + long, "（開いたまま。" + long, "(a)" * 30_000 + "。" + long, long.rstrip("。") * 4000]
    texts += ["".join(rng.choices("あいう漢字。。！？(（)） \n\x1c　x", weights=[9, 9, 9, 9, 9, 2, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 9], k=rng.randint(0, 200))) for _ in range(800)]
    texts += ["".join(rng.choices("あいう漢字。！?) \n　x", weights=[9, 9, 9, 9, 9, 1, 1, 1, 1, 2, 1, 1, 9], k=rng.randint(0, 200))) for _ in range(400)]  # nothing opens a bracket
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", C.sentences(F.col("t")).alias("s"))
    got = {r.k: r.s for r in rows.collect()}
    assert got == {k: split_sentences(t) for k, t in enumerate(texts)}


#: pattern, texts in which it finds just this, texts in which it finds nothing.
CASES = {
    "URL": ([("見よhttps://a.jp/x?y=1 次", "https://a.jp/x?y=1"), ("WWW.b.jp です", "WWW.b.jp")], ["ftp://a", "wwwx"]),
    "PHONE": ([("電話03-1234-5678番", "03-1234-5678"), ("（0120）123－4567 へ", "（0120）123－4567")], ["3-1234", "数は12345678901234"]),
    "MAIL": ([("宛先ir.x@a-b.co.jpまで", "ir.x@a-b.co.jp")], ["a@b", "＠a.jp"]),
    "ESTIMATE": ([("は2025年度（見込み）だ", "2025年度（見込み）"), ("2024(予測)", "2024(予測)")], ["2025年（実績）", ",2025年（見通し）"]),
    "FISCAL": ([("の令和6年3月期は", "令和6年3月期"), ("2024/3期", "2024/3期"), ("24/12期", "24/12期"), ("2024年 3月期", "2024年 3月期"), ("24年3月期", "24年3月期"), ("3月期", "3月期")], ["2024年3月", "13期", "△3月期"]),
    "TERM": ([("2023-2024年度", "2023-2024年度"), ("2024年4～6月に", "2024年4～6月"), ("2024/4～6 ", "2024/4～6"), ("4～6月", "4～6月"), ("2024年4月～6月", "2024年4月～6月"), ("2020～2024", "2020～2024")], ["4～6日", "4～6月 1日"]),
    "DATE": (
        [("令和6年4月1日に", "令和6年4月1日"), ("平成30年 4月に", "平成30年 4月"), ("2024年4月1日", "2024年4月1日"), ("2024-04-01", "2024-04-01"), ("4月1日", "4月1日"), ("2024年4月", "2024年4月"), ("2024/04 ", "2024/04"), ("2024と4 ", "2024と4"), ("24年4月", "24年4月"), ("24年4 ", "24年4")],
        ["令和の春", "20244", "+4月1日", "2041年"],
    ),
    "YEAR_TAG": ([("2024年度は", "2024年度"), ("FY2024と", "FY2024"), ("FY24は", "FY24")], ["2024年4", "2041年", "12024年"]),
    "MONTH_TAG": ([("は4月の", "4月"), ("12 月", "12 月")], ["4月1日", "0月"]),
    "DAY_TAG": ([("31日（金", "31日"), ("は5日 に", "5日")], ["5日に", "32日 "]),
    "DOT_BEFORE_DATE": ([("1.2024年", "."), ("3.4月", "."), ("2.15日", ".")], ["1.5倍", "a.4月"]),
    "SPACE_BEFORE": ([("2024 年", " "), ("4月 末日", " "), ("年　の末日", "　")], ["24 年", "4 月"]),
    "DELETED": ([("1日（月）に", "（月）"), ("午後3時30分から", "午後3時30分"), ("朝9時に", "9時"), ("、、次", "、、"), ("（代表）です", "（代表）")], ["（年）", "30時", "。次"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_each_pattern(spark, name):
    positive, negative = CASES[name]
    rows = spark.createDataFrame([(t,) for t, _ in positive] + [(t,) for t in negative], "t string")
    got = {r.t: r.x for r in rows.select("t", F.regexp_extract_all("t", F.lit(getattr(C, name)), F.lit(0)).alias("x")).collect()}
    assert {t: got[t] for t, _ in positive} == {t: [w] for t, w in positive}
    assert {t: got[t] for t in negative if t != "30時"} == {t: [] for t in negative if t != "30時"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024年末日1Q", "<YEAR_EXT>1Q"),
        ("2024年度上期と3月期第1四半期", "<YEAR_TERM_EXT>と<FISCAL_QUARTER1_EXT>"),
        ("20241Q", "2024 1Q"),
        ("1.2024年", "1.<YEAR>"),
        ("ab", "a・b"),
        ("　 前後 ", "前後"),
        ("10 億円と5人件費、▲3 ％", "10_億円と5人件費、-3_％"),
    ],
)
def test_steps_of_the_chain(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.cleaned(F.col("t")).alias("x")).first()["x"] == want


def plain(text):
    """The chain in plain Python, step by step; None stays."""
    if text is None:
        return None
    py = lambda p: re.sub(r"^\(\?i?u?U?\)", "(?i)" if p.startswith("(?i") else "", p)
    c = re.sub(C.INVISIBLE.encode().decode("unicode_escape") if "\\u" in C.INVISIBLE else C.INVISIBLE, "", text).translate(str.maketrans(C.WIDE, C.NARROW))
    header = "|".join(C.HEADERS)
    if re.match(f"(?s).{{0,300}}?(?:{header})", c):
        c = re.sub(rf"\A[^\n]*?(?:{header})", "", c, count=1)
    else:
        number = next((m for m in re.finditer(py(C.PHONE), c) if len(re.sub(r"\D", "", m[1])) >= 10), None)
        if number is not None and c.index(number[1]) < 200:
            c = c[c.index(number[1]) + len(number[1]) :]
    for phrase in (r"以\s*上", "|".join(C.CONTACTS)):
        ends = list(re.finditer(phrase, c))
        last = max((m.start() for m in ends), default=None)
        if last is not None and last >= len(c) - 200:
            c = c[:last]
    c = re.sub("(?i)" + "|".join(map(re.escape, C.NOISE)), "。", c)
    c = re.sub(py(C.DOT_BEFORE_DATE), ".#break#", c)
    c = re.sub(py(C.SPACE_BEFORE), "", c)
    for name in ("URL", "PHONE", "MAIL", "ESTIMATE"):
        c = re.sub(py(getattr(C, name)), f"<{name}>", c)
    c = re.sub(r"(?<=[^\n])((?:19[89][0-9]|20[0-2][0-9]){3,})", lambda m: " " + " ".join(["<YEAR>"] * (len(m[1]) // 4)), c)
    for name in ("FISCAL", "TERM", "DATE", "YEAR_TAG", "MONTH_TAG", "DAY_TAG"):
        c = re.sub(py(getattr(C, name)), f"<{name.removesuffix('_TAG')}>", c)
    units = sorted(C.UNITS, key=len, reverse=True)

    def unit(m):
        for u in units:
            if c[m.end() :].startswith(u) and not (u == "百万" and c[m.end() + 2 :].startswith("円")) and not any(e[len(u) :] and c[m.end() + len(u) :].startswith(e[len(u) :]) for e in C.NOT_UNITS):
                return f"{m[1]}_"
        return m[0]

    c = re.sub(r"(\d+(?:[,.]\d+)?)[\s　]*(?=" + "|".join(map(re.escape, units)) + ")", unit, c)
    c = re.sub(r"[△▲−ー－-](\d+)", r"-\1", re.sub(r"[＋+](\d+)", r"+\1", c))
    for word, name in C.EXTENSIONS.items():
        c = re.sub(f"<((?i:ESTIMATE|FISCAL|PERIOD|TERM|DATE|YEAR|MONTH|DAY))>{re.escape(word)}", rf"<\1_{name}>", c)
    c = re.sub("(?i)<(ESTIMATE|FISCAL|PERIOD|TERM|DATE|YEAR|MONTH|DAY)>[1-4]q", r"<\1_DEFAULT>", c)
    c = re.sub("(?i)(?<=[0-9])(?=[1-4]Q)", " ", c).replace(".#break#", ".")
    return re.sub(py(C.DELETED), "", re.sub("[-]", "・", c)).strip()


PIECES = [
    "２０２４年３月期", "令和6年4月1日（月）", "売上高は 1,234 百万円", "△5.2 ％", "▲3 円", "2025年度（見込み）", "4～6月", "2020～2024", "第1四半期", "上期", "末日", "1Q", "、、", "午後3時30分", "5 株主", "10 社", "3人件費", "ir@example.co.jp", "https://a.jp/x",
    "03-1234-5678", "お知らせ", "について", "以上", "お問い合わせ", "Copyright", "​", "", "202020212022", "1.2024年", "2024 年", "FY24", "12 月", "5日 ", "増配", "目次", "。", "（", "）", "という長い説明の文章が続きます。", "\n", "　", "FUJISOFT Incorporated", "24/12期", "2 倍", "100 pt",
]


def test_chain_equals_plain_python(spark):
    rng = random.Random(3)
    texts = [None, "", " ", *PIECES] + ["".join(rng.choices(PIECES, k=rng.randint(1, 40))) for _ in range(700)]
    got = {r.k: r.x for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", C.cleaned(F.col("t")).alias("x")).collect()}
    wrong = [(t, got[k], plain(t)) for k, t in enumerate(texts) if got[k] != plain(t)]
    assert not wrong, wrong[:3]


def test_notices_over_a_whole_table(spark):
    small = "/root/testdata/sf0.001"
    texts = {r.id: r.text for r in documents.notices(spark, small).collect()}
    rows = QUERIES["clean_notices"](spark, small).collect()
    tags = ["<FISCAL>", "<DATE>", "<TERM>", "<URL>"]
    assert len(rows) == len(texts) == 1500 and all(t in r.text for r in rows for t in tags)
    for r in rows:
        want = plain(texts[r.id])
        assert r.text == want
        kept = [s for s in split_sentences(want) if not any(w in s for w in C.LOW_PRIORITY) and not re.search(r"\b" + r"\s+".join(map(str, range(1, 13))) + r"\b", s)]
        assert r.body == "".join(kept)


def test_tables_and_sentinels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    rows = F.array(F.array(F.lit("品目 (a.b)"), F.lit(None).cast("string"), F.lit("金額")), F.array(F.lit("合計"), F.lit("1,234\\E+")))
    assert one(C.without_table_text(F.lit("前 品目 (a.b) 金額\n中\n合計 1,234\\E+ 後"), rows)) == "前  後"
    assert one(C.without_table_text(F.lit("x"), F.array().cast("array<array<string>>"))) == "x" and one(C.without_table_text(F.lit(None).cast("string"), rows)) is None
    assert one(C.or_sentinel(F.lit("a"), F.lit(None).cast("boolean"), F.lit(None).cast("string"))) == C.NOT_FETCHED
    assert one(C.or_sentinel(F.lit(""), F.lit(True), F.lit(None).cast("string"))) == C.NO_TEXT
    assert one(C.or_sentinel(F.lit(""), F.lit(True), F.lit("x"))) == C.FAILED + "x"


def test_the_chain_runs_once_for_both_columns(spark):
    """A text is cleaned once, however many columns and steps use it."""
    plan = QUERIES["clean_notices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS both#") <= 1 and plan.count("<FISCAL>") <= 2


def test_guards_change_no_result(spark):
    """Steps that are skipped for texts without their words, and patterns that look at the first character first, against the same without."""
    rng = random.Random(6)
    texts = [None, "", *PIECES] + ["".join(rng.choices(PIECES + ["\u3000", "年", "末", "2020", "0"], k=rng.randint(1, 9))) for _ in range(900)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    steps = {"DOT_BEFORE_DATE": ["年", "月", "日"], "SPACE_BEFORE": ["年", "末"], "MAIL": ["@"], "ESTIMATE": ["見込み", "見通し", "予測"], "FISCAL": ["期"], "MONTH_TAG": ["月"], "DAY_TAG": ["日"], "PHONE": [""], "TERM": [""], "DATE": [""], "YEAR_TAG": [""], "DELETED": [""]}
    for name, words in steps.items():
        pattern = getattr(C, name)
        plain_pattern = re.sub(r"^(\(\?\w+\))\(\?=(?:\(\?-i:\[[^\]]*\]\)|\[[^\]]*\](?:\|\\s\+(?:0|\[0-9\]))?)\)", r"\1", pattern)
        assert (plain_pattern != pattern) == (name not in ("DOT_BEFORE_DATE", "SPACE_BEFORE", "MAIL"))
        assert rows.where(~C.replaced(F.col("t"), words, pattern, "<X>").eqNullSafe(F.regexp_replace("t", plain_pattern, "<X>"))).count() == 0, name


def test_notices_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(documents, "ROWS_A_TASK", 100)
    assert documents.notices(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 16
