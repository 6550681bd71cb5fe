"""Technical indicators as columns over one window per series.

All take the window of a series (partitioned by code, ordered by date) and
build on the same partitioning and order, so a chain of them sorts once. A
rolling value is null until its frame has `least` values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def rolling(aggregate: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), aggregate(c).over(frame))


def previous(c: str, w: WindowSpec) -> Column:
    return F.lag(c).over(w)


def percent_change(c: str, w: WindowSpec) -> Column:
    """From the last value that isn't null, in hundredths; null for the first."""
    before = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (F.try_divide(F.coalesce(F.col(c), before), before) - 1) * 100


def true_range(w: WindowSpec) -> Column:
    before = previous("close", w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def gain(c: str, w: WindowSpec) -> Column:
    return F.greatest(F.coalesce(F.col(c) - previous(c, w), F.lit(0.0)), F.lit(0.0))


def loss(c: str, w: WindowSpec) -> Column:
    return F.greatest(F.coalesce(previous(c, w) - F.col(c), F.lit(0.0)), F.lit(0.0))


def strength(mean_gain: Column, mean_loss: Column) -> Column:
    """Relative strength of mean gain and loss: 100 without losses, null without either."""
    return F.when(mean_loss > 0, 100 - 100 / (1 + mean_gain / F.nullif(mean_loss, F.lit(0.0)))).when(mean_gain > 0, F.lit(100.0))


def percent_r(w: WindowSpec, n: int = 14) -> Column:
    """0 at the frame's high, 100 at its low."""
    high, low = rolling(F.max, F.col("high"), w, n), rolling(F.min, F.col("low"), w, n)
    return F.try_divide(100 * (high - F.col("close")), high - low)


def directional(w: WindowSpec) -> tuple[Column, Column]:
    """Upward and downward movement, each cut at 0 for itself."""
    up = F.greatest(F.coalesce(F.col("high") - previous("high", w), F.lit(0.0)), F.lit(0.0))
    down = F.greatest(F.coalesce(previous("low", w) - F.col("low"), F.lit(0.0)), F.lit(0.0))
    return up, down


def ewm_last(values: Column, span: int) -> Column:
    """The last value of an exponentially weighted mean of an array, started at its first: one pass, no array is built."""
    keep = 1 - 2 / (span + 1)
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.get(values, F.lit(0)), lambda s, x: s * keep + x * (1 - keep))


def macd_last(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(fast, slow, signal) after the last value of an array."""
    step = lambda s, x, span: s * (1 - 2 / (span + 1)) + x * (2 / (span + 1))
    pack = lambda a, b, c: F.struct(a.alias("fast"), b.alias("slow"), c.alias("signal"))
    first = F.get(values, F.lit(0))

    def onward(s: Column, x: Column) -> Column:
        a, b = step(s["fast"], x, fast), step(s["slow"], x, slow)
        return pack(a, b, step(s["signal"], a - b, signal))

    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), pack(first, first, F.lit(0.0)), onward)


def guarded_corr(a: str, b: str) -> Column:
    """Pearson correlation of rows where both aren't null; 0 where it isn't defined."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def q4(c: Column) -> Column:
    """Four decimals, halves up."""
    return F.floor(c * 10_000.0 + 0.5) / 10_000.0
