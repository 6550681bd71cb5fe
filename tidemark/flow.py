"""The disclosure flow end to end: collect days, catch up on old ones, build a day's training set, train, predict.

Everything a flow keeps lies below one folder, each part as committed versions:
`days` (disclosures by day), `errors`, `next` (the place in the old lists),
`training` (weights, losses and the day in training). A call that breaks off
leaves the last commit, and is called again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import daily, paging, regressor, relational, training
from tidemark.sources import chain, pages, store
from tidemark.streaming import ingest

DISCLOSURE = "date date, time string, code string, name string, title string, url string, text string, seq long, date_key string"
KEYS = ["code", "title"]
#: Errors with which rows aren't stored.
MOST_ERRORS = 5


class Market(NamedTuple):
    """Bars (code, date, open, high, low, close, volume), the same of two indices without code, and typed statements."""

    bars: DataFrame
    index: DataFrame
    growth: DataFrame
    statements: DataFrame


class State(NamedTuple):
    """What there is so far; day: the next to train."""

    day: str
    next_page: str | None
    has_days: bool
    has_model: bool


class Flow:
    """texts gives url and document of disclosures (date, code, title, url), or an error text that begins with 'Error'."""

    def __init__(self, spark: SparkSession, root: str, market: Market, texts: Callable[[DataFrame], DataFrame], start: str, excluded: dict[str, list[str]] | None = None, base: str = "") -> None:
        self.spark, self.market, self.texts, self.base = spark, market, texts, base
        self.excluded = excluded or {}
        self.days, self.errors = f"{root}/days", f"{root}/errors"
        self.cursor = store.Cursor(spark, f"{root}/next")
        self.trainer = daily.DayTrainer(spark, f"{root}/training", start, self.training_rows, self.following)

    # --- collecting ---

    def disclosures(self, lists: DataFrame) -> DataFrame:
        """The rows of list pages (page, html): day, code, name and title with its link; kept ones, with their text."""
        rows = lists.select("page", F.posexplode(pages.list_rows(F.col("html"), 4)).alias("place", "c"))
        title, url = pages.title_and_path(F.get("c", F.lit(3)), self.base)
        when = F.get("c", F.lit(0))
        day = F.to_date(F.try_to_timestamp(F.regexp_extract(when, r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", 0).alias("d"), F.lit("yyyy/M/d")))
        time = F.nullif(F.regexp_extract(when, r"\d{1,2}:\d{2}", 0), F.lit(""))
        text = lambda k: F.nullif(F.trim(F.get("c", F.lit(k))), F.lit(""))
        # later pages and lower places are older
        found = rows.select(day.alias("date"), time.alias("time"), text(1).alias("code"), text(2).alias("name"), F.trim(title).alias("title"), url.alias("url"), (-(F.col("page") * 100_000 + F.col("place"))).cast("long").alias("seq"))
        found = relational.kept(found, "code", self.excluded).where("date is not null")
        known = self.texts(found.select("date", "code", "title", "url")).select("url", F.col("document").alias("text"))
        return found.join(known.dropDuplicates(["url"]), "url", "left").withColumn("date_key", F.date_format("date", "yyyy-MM-dd"))

    def stored_days(self, days: list[str] | None = None) -> DataFrame:
        whole = self.spark.createDataFrame([], DISCLOSURE).schema
        return store.read_days(self.spark, self.days, whole, days)

    def daily_disclosures(self, lists: DataFrame, day: str) -> DataFrame:
        """Stores a day's disclosures in place of what was stored of it, and gives those that are new since."""
        rows = store.stored(self.disclosures(lists).where(F.col("date_key") == day), "daily")
        before = store.stored(self.stored_days([day]).select(*KEYS), "daily-before")
        if rows.limit(1).count():
            store.replace_days(rows.select(*(c.split()[0] for c in DISCLOSURE.split(", "))), self.days)
        return relational.new_rows(rows, before, KEYS)

    def backfill_step(self, path: str, most: int = 1, **options: str) -> str:
        """Reads the next `most` pages of a chain of old lists and merges their days; moves on if there are fewer than MOST_ERRORS errors and the chain goes on. What became of it: `stored`, `errors` or `end`."""
        start = self.cursor.value() or options.pop("start", "")
        lists = store.stored(chain.read_chain(self.spark, path, start=start, most=str(most), **options), "backfill")
        last = lists.orderBy(F.desc("page")).select("next").first()
        rows = store.stored(self.disclosures(lists), "backfill-rows")
        if last is None or not rows.limit(1).count():
            return "end"
        failed = relational.error_gate(rows.withColumn("all", F.lit(1)), "text", "all", MOST_ERRORS).first()
        if not failed["passed"]:
            store.write_errors(rows.drop("date_key"), self.errors, "date")
            return "errors"
        if last["next"] is None:
            return "end"
        ingest.store_days(rows, self.days, "date", KEYS, "seq", today=False)
        self.cursor.advance(last["next"])
        return "stored"

    # --- learning ---

    def events(self, day: str) -> DataFrame:
        """The day's disclosures with an id, the number in their order."""
        rows = self.stored_days([day]).where("text is not null").where(~F.col("text").rlike("(?i)^Error"))
        return paging.numbered(rows.select("code", "date", "title", "url", "text"), ["code", "title", "url", "text"], "id")

    def features(self, events: DataFrame) -> DataFrame:
        m = self.market
        return training.features(events.select("id", "code", "date"), m.statements, m.bars, m.index, m.growth)

    def build_training_set(self, day: str) -> DataFrame:
        """id, features, targets and document of the day's disclosures that have them."""
        events = store.stored(self.events(day), "events")
        return training.work_set(self.features(events), events, self.market.bars, events.select("id", F.col("text").alias("document")))

    def training_rows(self, day: str) -> DataFrame:
        return self.build_training_set(day).select("id", regressor.hashed_words("document").alias("text_vector"), "features", "targets")

    def following(self, day: str) -> str | None:
        """The next stored day, at most ten on."""
        found = self.stored_days().where((F.col("date_key") > day) & (F.col("date_key") <= F.date_format(F.date_add(F.lit(day).cast("date"), 10), "yyyy-MM-dd")))
        return found.agg(F.min("date_key")).first()[0]

    def fit(self, **options) -> str | None:
        """Trains on the next day; the day, or None if there is nothing to train on."""
        return self.trainer.step(**options)

    def predict(self, day: str) -> DataFrame:
        """code, date, title and rates by name of the day's disclosures with features; no rows without a model."""
        weights = self.trainer.state().weights
        events = store.stored(self.events(day), "events")
        if weights is None:
            return events.limit(0).select("code", "date", "title", F.lit(None).cast("map<string,double>").alias("rates"))
        vectors = self.features(events).select("id", training.vector({c: F.col(c) for c in training.FEATURES}, training.FEATURES).alias("features"))
        rows = vectors.join(events, "id").select("id", regressor.hashed_words("text").alias("text_vector"), "features")
        return events.join(regressor.predict(rows, weights), "id").select("code", "date", "title", "rates")

    # --- looking ---

    def lines(self, size: int = 5) -> Iterator[str]:
        """All stored disclosures as lines of JSON, newest day first, read page by page."""
        order = [F.desc("date_key"), "code", "title", "url"]
        paged = store.stored(paging.pages(self.stored_days().select("date_key", "time", "code", "name", "title", "url"), order, size), "lines")
        page = 0
        while rows := paged.where(F.col("page") == page).orderBy(*order).collect():  # `size` rows
            for r in rows:
                yield json.dumps({k: v for k, v in r.asDict().items() if k != "page"}, ensure_ascii=False)
            page += 1

    def state(self) -> State:
        trained = self.trainer.state()
        return State(trained.day, self.cursor.value(), bool(store.committed(self.spark, self.days)), trained.weights is not None)

    def reset(self) -> None:
        """Forgets the model and the day in training; what was collected stays."""
        self.trainer.reset()
