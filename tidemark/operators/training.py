"""The training set: features, targets and text of each disclosure in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import guarded_corr, percent_change
from tidemark.operators import fundamentals, prices, recurrences
from tidemark.sources.store import stored

# --- fixed values: the features and targets in the network's order ---

FEATURES = ("eps", "roe", "per", "pbr", "cap_log", "index_corr", "growth_corr", "rsi14", "ma50", "ma200", "atr", "macd", "signal", "upper", "lower", "pr14", "adx14")
TARGETS = tuple(f"rate_{d}" for d in prices.HORIZONS)
#: Indicators whose last value is looked for in the days before the event alone, and in the whole series up to it.
LAST_NEAR, LAST_EVER = ("rsi14", "ma50", "ma200"), ("upper", "lower", "pr14", "adx14")
DAYS_BACK = 200
#: Of its sum of squares, the share of a variance below which it is rounding.
NO_SPREAD = 1e-11


def ratios_at(events: DataFrame, statements: DataFrame, bars: DataFrame) -> DataFrame:
    """Events on a trading day of their code, with its latest statement's ratios at that day's open."""
    opening = bars.select("code", "date", F.col("open").alias("price"))
    return fundamentals.ratios(fundamentals.imputed(fundamentals.as_of(events, statements)).join(opening, ["code", "date"]))


def by_ordinal(window: DataFrame, indices: DataFrame) -> DataFrame:
    """The bars of each event's window with the indices' changes of the day at the same place among the indices' days in it, if the event's code has a bar that day.

    indices: a row a day (date, index_change, growth_change), so it's broadcast whole.
    """
    days = indices.withColumn("ordinal", F.row_number().over(Window.orderBy("date")))
    span = indices.agg(F.min("date").alias("low"), F.max("date").alias("high")).select(F.explode(F.sequence(F.date_sub("low", DAYS_BACK + 1), F.col("high"))).alias("date"))
    following = Window.orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    begin = span.join(days.select("date", "ordinal"), "date", "left").select(F.date_add("date", DAYS_BACK).alias("date"), F.first("ordinal", ignorenulls=True).over(following).alias("begin"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("bar_date"))
    # a window has no more than DAYS_BACK + 1 days, so each of its bars carries them and no join is needed
    own = F.collect_list("bar_date").over(Window.partitionBy("id"))
    placed = window.withColumn("place", place).withColumn("_days", own).join(F.broadcast(begin), "date", "left").withColumn("ordinal", F.col("begin") + F.col("place") - 1)
    paired = placed.join(F.broadcast(days.withColumnRenamed("date", "index_date")), "ordinal", "left")
    return paired.select("id", "bar_date", "atr14", "change", *(F.when(F.array_contains("_days", F.col("index_date")), F.col(c)).alias(c) for c in ("index_change", "growth_change")))


def marked(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars, one a code and day, with `asked`, whether an event falls on them. One shuffle by code, which also puts each code's series in place."""
    values = [c for c in bars.columns if c not in ("code", "date")]
    nothing = [F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in values]
    rows = bars.withColumn("asked", F.lit(False)).unionByName(events.select("code", "date", *nothing, F.lit(True).alias("asked"))).repartition("code")
    # only a bar has the mark False
    found = rows.groupBy("code", "date").agg(*(F.max(c).alias(c) for c in values), F.max("asked").alias("asked"), F.min("asked").alias("_alone"))
    return found.where(~F.col("_alone")).drop("_alone")


def vector(record: dict[str, Column], keys: tuple[str, ...]) -> Column:
    """The values of named columns as an array in the order of keys, missing ones 0."""
    return F.array(*(F.coalesce(record[k].cast("double"), F.lit(0.0)) if k in record else F.lit(0.0) for k in keys))


def named(values: Column, keys: tuple[str, ...]) -> Column:
    """An array as a map from keys, in their order, to its values."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), values)


def features(events: DataFrame, statements: DataFrame, bars: DataFrame, index: DataFrame, growth: DataFrame, align: str = "date") -> DataFrame:
    """id, date, code and FEATURES of events on a trading day of their code with a statement.

    bars: made once, as all features hang on them. An event's day is a bar of
    its code, so the last values up to it are columns of that bar; only bars of
    such days leave the series' places. align: by
    `date`, or by `ordinal`, the place in the event's own series and in the
    index's of the same days.
    """
    daily = lambda rows, name: rows.select("date", percent_change("close", Window.orderBy("date")).alias(name))  # noqa: E731  a row a day
    w = prices.series()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), "date")), ignorenulls=True).over(upto)
    near = lambda s: F.when(s["date"] >= F.date_sub("date", DAYS_BACK), s["value"])
    # every bar has a macd and a signal, so those of the event's day are the last
    macd = recurrences.with_macd(marked(bars.select("code", "date", "close"), events), shown="asked").drop("close", "asked")
    found = prices.with_indicators(marked(bars.select("code", "date", "open", "high", "low", "close", "volume"), events))
    last = found.select("code", "date", "asked", "change", "atr14", *((near(seen(c)) if c in LAST_NEAR else F.last(c, ignorenulls=True).over(upto)).alias(c) for c in LAST_NEAR + LAST_EVER))
    base = stored(ratios_at(events, statements, bars).select("id", "code", "date", "eps", "roe", "per", "pbr", "cap_log"), "ratios")
    indices = daily(index, "index_change").join(daily(growth, "growth_change"), "date", "full")
    if align == "ordinal":
        ranges = last.select("code", "date", "change", "atr14")
        window = prices.around(ranges, base.select("id", "code", "date"), F.date_sub("date", DAYS_BACK), F.date_add("date", 1)).select("id", "date", "bar_date", "change", "atr14")
        technical = by_ordinal(window, indices).groupBy("id").agg(F.avg("atr14").alias("atr"), guarded_corr("change", "index_change").alias("index_corr"), guarded_corr("change", "growth_change").alias("growth_corr"))
        found = base.join(technical, "id").join(last.where("asked").drop("asked", "change", "atr14"), ["code", "date"])
    else:
        found = base.join(trailing(last.join(F.broadcast(indices), "date", "left")).where("asked").drop("asked"), ["code", "date"])
    return found.join(macd, ["code", "date"]).select("id", "code", "date", *FEATURES)


def trailing(bars: DataFrame) -> DataFrame:
    """Bars (code, date, change, atr14, index_change, growth_change, ...) with atr, index_corr and growth_corr over the DAYS_BACK days up to each, as differences of running sums: a step a bar, however long the days behind it are."""
    upto = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code").orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -(DAYS_BACK + 1))
    terms = {"atr_n": F.col("atr14").isNotNull().cast("long"), "atr_sum": F.col("atr14")}
    for name, other in (("i", "index_change"), ("g", "growth_change")):
        both = F.col("change").isNotNull() & F.col(other).isNotNull()
        x, y = F.col("change"), F.col(other)
        terms |= {f"{name}_{k}": F.when(both, v) for k, v in (("n", F.lit(1)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))}
    summed = bars.select("*", *(F.sum(v).over(upto).alias(f"_{k}") for k, v in terms.items()))
    gone = summed.withColumn("_gone", F.last(F.struct(*(f"_{k}" for k in terms))).over(before))
    part = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(0)) - F.coalesce(F.col(f"_gone._{k}"), F.lit(0))
    atr = F.try_divide(part("atr_sum"), part("atr_n"))
    return gone.select(*bars.columns, atr.alias("atr"), corr_of_sums(part, "i").alias("index_corr"), corr_of_sums(part, "g").alias("growth_corr")).drop("change", "atr14", "index_change", "growth_change")


def corr_of_sums(part: Callable[[str], Column], name: str) -> Column:
    """Pearson correlation from sums; 0 where it isn't defined. What a difference of sums leaves of no variance is taken for none."""
    n, x, y, xx, yy, xy = (part(f"{name}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    spread = lambda s, ss: F.greatest(ss - F.try_divide(s * s, n), F.lit(0.0))
    sx, sy = spread(x, xx), spread(y, yy)
    return F.when((n >= 2) & (sx > NO_SPREAD * xx) & (sy > NO_SPREAD * yy), (xy - F.try_divide(x * y, n)) / F.sqrt(sx * sy)).otherwise(F.lit(0.0))


def work_set(feats: DataFrame, events: DataFrame, bars: DataFrame, documents: DataFrame) -> DataFrame:
    """id, features, targets, document: features missing are 0, targets are carried forward; events without a bar or a document, or without any rate, are dropped.

    documents: id and document, the text of each event.
    """
    targets = prices.change_rates(bars).select("code", "date", *prices.carried())
    goal = F.array(*(F.col(f"target_{d}") for d in prices.HORIZONS)).alias("targets")
    whole = feats.join(targets, ["code", "date"]).join(documents.where("document is not null"), "id")
    return whole.select("id", vector({c: F.col(c) for c in FEATURES}, FEATURES).alias("features"), goal, "document").where(~F.exists("targets", lambda t: t == prices.NO_RATE))
