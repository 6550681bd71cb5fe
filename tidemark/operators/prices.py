"""Series operators: indicators per bar, forward change rates, windows around a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import indicators as I

#: Bars ahead at which forward change rates are taken, and what stands for none at all.
HORIZONS = (0, 3, 7, 14, 21, 28, 35, 42, 49)
NO_RATE = -9999.0


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("code",))).orderBy("date")


def with_indicators(bars: DataFrame) -> DataFrame:
    """Bars with change, ma50, ma200, rsi14, tr, atr14, upper, lower, pr14 and adx14. Two window steps, one shuffle and sort."""
    w = series()
    up, down = I.directional(w)
    first = bars.select("*", I.percent_change("close", w).alias("change"), I.gain("close", w).alias("gain"), I.loss("close", w).alias("loss"), I.true_range(w).alias("tr"), up.alias("up"), down.alias("down"))
    mean = I.rolling(F.avg, F.col("close"), w, 20)
    spread = I.rolling(F.stddev_samp, F.col("close"), w, 20)
    atr = I.rolling(F.avg, F.col("tr"), w, 14)
    pdi, ndi = (F.try_divide(I.rolling(F.sum, F.col(c), w, 14), atr) * 100 for c in ("up", "down"))
    second = first.select(
        "*",
        I.rolling(F.avg, F.col("close"), w, 50, 1).alias("ma50"),
        I.rolling(F.avg, F.col("close"), w, 200, 1).alias("ma200"),
        I.strength(I.rolling(F.avg, F.col("gain"), w, 14), I.rolling(F.avg, F.col("loss"), w, 14)).alias("rsi14"),
        I.rolling(F.avg, F.col("tr"), w, 14, 1).alias("atr14"),
        (mean + 2 * spread).alias("upper"),
        (mean - 2 * spread).alias("lower"),
        I.percent_r(w).alias("pr14"),
        pdi.alias("pdi"),
        ndi.alias("ndi"),
    )
    spread_of = F.try_divide(F.abs(F.col("pdi") - F.col("ndi")), F.col("pdi") + F.col("ndi"))
    return second.withColumn("dx", spread_of).withColumn("adx14", I.rolling(F.avg, F.col("dx"), w, 14) * 100)


def closes(bars: DataFrame) -> DataFrame:
    """code and its closes in order of date, as an array."""
    return bars.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda r: r["close"]).alias("closes"))


def change_rates(bars: DataFrame, days: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each bar's forward change rates in hundredths of its own close; day 0 is from open to close; null past the series' end."""
    w, close = series(), F.col("close")
    rate = lambda d: F.try_divide(close - F.col("open") if d == 0 else F.lead("close", d).over(w) - close, close) * 100
    return bars.select("*", *(rate(d).alias(f"rate_{d}") for d in days))


def carried(days: tuple[int, ...] = HORIZONS) -> list[Column]:
    """The rates of change_rates(), a missing one replaced by that of the nearest shorter horizon, else NO_RATE."""
    return [F.coalesce(*(F.col(f"rate_{d}") for d in reversed(days[: k + 1])), F.lit(NO_RATE)).alias(f"target_{days[k]}") for k in range(len(days))]


def around(bars: DataFrame, events: DataFrame, start: Column, end: Column, span: int = 201) -> DataFrame:
    """Events joined with the bars of their code from start to before end.

    Days are dealt to buckets of `span` days, about the length of a window: an
    event meets the bars of its code in the buckets that its window touches,
    not the whole series.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / span)
    near = events.select("*", start.alias("_start"), end.alias("_end")).where("_start < _end")
    near = near.select("*", F.explode(F.sequence(bucket("_start"), F.floor((F.unix_date("_end") - 1) / span))).alias("_bucket"))
    dealt = bars.withColumnRenamed("date", "bar_date").withColumn("_bucket", bucket("bar_date"))
    found = near.join(dealt, ["code", "_bucket"]).where((F.col("bar_date") >= F.col("_start")) & (F.col("bar_date") < F.col("_end")))
    return found.select(*events.columns, *(c for c in dealt.columns if c not in ("code", "_bucket")))


def aligned_changes(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """code, change and index_change of a stock's and an index's bars, paired by `date` or by ordinal (the place in each series)."""
    w = series()
    if by == "ordinal":
        left, right = left.withColumn("ordinal", F.row_number().over(w)), right.withColumn("ordinal", F.row_number().over(Window.orderBy("date")))
    return left.select("code", by, "change").join(right.select(by, F.col("change").alias("index_change")), by)
