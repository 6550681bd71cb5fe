"""From list pages to predictions on a small market."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import flow
from tidemark.operators import fundamentals
from tidemark.sources import chain

ROW = "<tr><td>{when}</td><td>{code}</td><td>N{code}</td><td><a href='/d/{code}-{k}'>{title}</a></td></tr>"
DAYS = ["2024-05-01", "2024-05-02", "2024-05-07"]


def page(rows, following=None):
    table = "".join(ROW.format(when=w, code=c, k=k, title=t) for w, c, k, t in rows)
    return f"<table class='cs'>{table}</table>" + (f'<table><tr id="loading" data-nx="/{following}"></tr></table>' if following else "")


def slash(day):
    return day.replace("-", "/")


@pytest.fixture(scope="module")
def market(spark):
    rng, rows = random.Random(3), []
    first = datetime.date(2023, 6, 1)
    for code in ("1301", "1302", "1303"):
        price = 1000.0
        for k in range(420):
            price = round(price * (1 + 0.02 * math.sin(k / 9) * rng.random()) + rng.randint(-9, 9))
            rows.append((code, first + datetime.timedelta(k), price - 3.0, price + 9.0, price - 8.0, float(price), 100.0 + k))
    bars = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")
    index = bars.where("code = '1301'").drop("code")
    fin = spark.createDataFrame([(c, "2024/03", "9000", "4000", "300", "40", "10", "7", "-") for c in ("1301", "1302", "1303")], "code string, year string, assets string, equity string, profit string, bps string, eps string, roe string, roa string")
    return flow.Market(bars, index, index, fundamentals.typed(fin))


def texts(found):
    """A document for each link; that of one code can't be read."""
    return found.select("url", F.when(F.col("code") == "9999", F.lit("Error: no file")).otherwise(F.concat(F.lit("profit of "), "code", F.lit(" rose on "), F.col("date").cast("string"))).alias("document"))


def test_from_lists_to_predictions(spark, tmp_path, market):
    source, root = str(tmp_path / "lists"), str(tmp_path / "kept")
    folder = chain.Folder(source)
    folder.put("first", page([(f"{slash(DAYS[1])} 09:05", "1301", 1, "増配"), (slash(DAYS[0]), "1302", 2, "決算"), (slash(DAYS[0]), "1302", 2, "決算"), (slash(DAYS[0]), "", 3, "no code"), (slash(DAYS[0]), "1303", 4, "日々の開示")], "second"))
    folder.put("second", page([(slash(DAYS[0]), "1301", 5, "修正"), ("no day", "1301", 6, "x")], "third"))
    folder.put("third", page([(slash(DAYS[0]), "9999", k, f"t{k}") for k in range(6)], "fourth"))
    f = flow.Flow(spark, root, market, texts, DAYS[0], {"title": ["日々の開示"]}, "https://x/")
    assert f.state() == (DAYS[0], None, False, False) and f.fit() is None and f.predict(DAYS[0]).count() == 0 and list(f.lines()) == []

    assert f.backfill_step(source, start="first") == "stored" and f.state().next_page == "second"
    assert f.backfill_step(source) == "stored" and (f.cursor.value(), f.cursor.backup()) == ("third", "second")
    assert f.backfill_step(source) == "errors" and f.cursor.value() == "third"  # six texts that can't be read
    folder.put("third", page([]))
    assert f.backfill_step(source) == "end"
    stored = lambda: sorted((r.date_key, r.code, r.title, r.url) for r in f.stored_days().collect())
    old = [(DAYS[0], "1301", "修正", "https://x/d/1301-5"), (DAYS[0], "1302", "決算", "https://x/d/1302-2"), (DAYS[1], "1301", "増配", "https://x/d/1301-1")]
    assert stored() == old

    today = lambda *rows: spark.createDataFrame([(1, page(rows))], "page long, html string")
    new = f.daily_disclosures(today((slash(DAYS[2]), "1303", 1, "増配")), DAYS[2])
    assert [r.code for r in new.collect()] == ["1303"]
    new = f.daily_disclosures(today((slash(DAYS[2]), "1302", 2, "自社株"), (slash(DAYS[2]), "1303", 1, "増配")), DAYS[2])
    assert [r.code for r in new.collect()] == ["1302"] and len(stored()) == 5
    assert f.daily_disclosures(today(), DAYS[2]).count() == 0 and len(stored()) == 5

    work = f.build_training_set(DAYS[0]).collect()
    assert sorted(r.document for r in work) == ["profit of 1301 rose on 2024-05-01", "profit of 1302 rose on 2024-05-01"]
    assert all(len(r.features) == 17 and len(r.targets) == 9 for r in work)
    assert [f.fit(epochs=2) for _ in range(4)] == [DAYS[0], DAYS[1], DAYS[2], None]
    assert f.state() == (DAYS[2], "third", True, True) and list(f.trainer.state().losses) == DAYS
    rates = {r.code: r.rates for r in f.predict(DAYS[2]).collect()}
    assert set(rates) == {"1302", "1303"} and all(len(r) == 9 and all(map(math.isfinite, r.values())) for r in rates.values())

    lines = [json.loads(x) for x in f.lines(2)]
    assert [(x["date_key"], x["code"]) for x in lines] == [(DAYS[2], "1302"), (DAYS[2], "1303"), (DAYS[1], "1301"), (DAYS[0], "1301"), (DAYS[0], "1302")]
    assert lines[2]["time"] == "09:05" and lines[0]["name"] == "N1302"
    f.reset()
    assert f.state() == (DAYS[0], "third", True, False)
