"""Means that feed on their own last value, as a scan over pieces of a series.

A step of an exponentially weighted mean, m' = k m + (1 - k) x, is an affine
map of m, and maps compose: after t steps m is k^t times what it was, plus
what the values add. A series is cut into stretches of PIECE days. Within a
stretch the sums over its values are windows that begin at 0; a stretch as a
whole is one map of few numbers; the maps of a series are run through in
order, which gives the state at which each stretch begins; that state's share
is added to every bar. No task needs a whole series, and all is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch. Weights within one reach k ** -PIECE, which a double holds for spans of 2 and more.
PIECE = 256


def kept_share(span: int) -> float:
    """k of a span: what a mean keeps of itself in a step."""
    if span < 2:
        raise ValueError("a span is 2 or more")
    return 1 - 2 / (span + 1)


def power(k: float, n: Column) -> Column:
    return F.pow(F.lit(k), n)


def crossed(k: float, by: float, n: Column) -> Column:
    """What a mean with share `by`, fed for n steps by one that starts at 1 with share k, has gathered: the sum of (1 - by) by^(n - i) k^i over i = 1 .. n."""
    if k == by:
        return (1 - by) * n * power(k, n)
    return (1 - by) * k / (by - k) * (power(by, n) - power(k, n))


def with_means(rows: DataFrame, value: str, spans: dict[str, int], key: str = "code", day: str = "date") -> DataFrame:
    """Rows with an exponentially weighted mean of `value` for each name and span, each started at the series' first value. One row a day and series; values aren't null."""
    own = Window.partitionBy(key, "_piece").orderBy(day)
    at = F.row_number().over(own)
    local = rows.withColumn("_piece", F.floor(F.unix_date(day) / PIECE)).withColumn("_n", at)
    local = local.select("*", *(sum_in_piece(F.col(value), kept_share(s), own).alias(f"_{n}") for n, s in spans.items()))
    whole = local.groupBy(key, "_piece").agg(F.max("_n").alias("n"), F.min_by(value, "_n").alias("first"), F.max_by(F.struct(*(F.col(f"_{n}").alias(n) for n in spans)), "_n").alias("local"))
    onward = {n: (lambda s, p, n=n, k=kept_share(s): s[n] * power(k, p["n"]) + p["local"][n]) for n, s in spans.items()}
    begun = starts(whole, key, {n: (lambda p: p["first"]) for n in spans}, onward)
    found = local.join(begun, [key, "_piece"])
    return found.select(*rows.columns, *((F.col(f"_{n}") + F.col(f"_begin.{n}") * power(kept_share(s), F.col("_n"))).alias(n) for n, s in spans.items()))


def sum_in_piece(value: Column, k: float, own) -> Column:
    """The mean within a stretch that begins at 0: weights k^-n make it a running sum."""
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value * power(1 / k, F.col("_n"))).over(upto) * (1 - k) * power(k, F.col("_n"))


def starts(whole: DataFrame, key: str, first, onward) -> DataFrame:
    """key, _piece and _begin, the state before each stretch: first[name](stretch) before a series' first, then onward[name](state, stretch)."""
    pieces = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_piece", *(c for c in whole.columns if c not in (key, "_piece"))))).alias("pieces"))
    state = lambda make: F.struct(*(make(n).alias(n) for n in first))
    begin = F.struct(state(lambda n: first[n](F.get("pieces", F.lit(0))).cast("double")).alias("state"), F.expr("cast(array() as array<struct<_piece: bigint, _begin: struct<" + ", ".join(f"{n}: double" for n in first) + ">>>)").alias("seen"))

    def step(acc: Column, piece: Column) -> Column:
        seen = F.struct(piece["_piece"].alias("_piece"), acc["state"].alias("_begin"))
        return F.struct(state(lambda n: onward[n](acc["state"], piece)).alias("state"), F.concat(acc["seen"], F.array(seen)).alias("seen"))

    return pieces.select(key, F.inline(F.aggregate("pieces", begin, step)["seen"]))


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, shown: str | None = None) -> DataFrame:
    """Bars with macd, the fast mean of the close less the slow one, and signal, the mean of macd, which starts at 0. shown: a column that says which bars to give, all of which count."""
    a, b, c = map(kept_share, (fast, slow, signal))
    own = Window.partitionBy("code", "_piece").orderBy("date")
    local = bars.withColumn("_piece", F.floor(F.unix_date("date") / PIECE)).withColumn("_n", F.row_number().over(own))
    local = local.select("*", sum_in_piece(F.col("close"), a, own).alias("_fast"), sum_in_piece(F.col("close"), b, own).alias("_slow"))
    local = local.withColumn("_signal", sum_in_piece(F.col("_fast") - F.col("_slow"), c, own))
    whole = local.groupBy("code", "_piece").agg(F.max("_n").alias("n"), F.min_by("close", "_n").alias("first"), F.max_by(F.struct("_fast", "_slow", "_signal"), "_n").alias("local"))
    # the signal is fed by both means: what they hold at the start of a stretch goes on to it
    begun = starts(
        whole,
        "code",
        {"fast": lambda p: p["first"], "slow": lambda p: p["first"], "signal": lambda p: F.lit(0.0)},
        {
            "fast": lambda s, p: s["fast"] * power(a, p["n"]) + p["local"]["_fast"],
            "slow": lambda s, p: s["slow"] * power(b, p["n"]) + p["local"]["_slow"],
            "signal": lambda s, p: s["signal"] * power(c, p["n"]) + s["fast"] * crossed(a, c, p["n"]) - s["slow"] * crossed(b, c, p["n"]) + p["local"]["_signal"],
        },
    )
    found = (local.where(shown) if shown else local).join(begun, ["code", "_piece"])
    n, begin = F.col("_n"), F.col("_begin")
    macd = F.col("_fast") + begin["fast"] * power(a, n) - F.col("_slow") - begin["slow"] * power(b, n)
    mean = F.col("_signal") + begin["signal"] * power(c, n) + begin["fast"] * crossed(a, c, n) - begin["slow"] * crossed(b, c, n)
    return found.select(*bars.columns, macd.alias("macd"), mean.alias("signal"))
