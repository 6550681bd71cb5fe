"""Annual financials: typing, as-of lookup, imputation and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: str) -> Column:
    """Text as a number; '-' and other text are null."""
    return F.col(c).try_cast("double")


def typed(statements: DataFrame) -> DataFrame:
    """Numbers as doubles and fiscal_end, the last day of a 'YYYY/MM' year; other years are dropped."""
    month = F.to_date(F.regexp_extract("year", r"^(\d{4}/\d{2})$", 1), "yyyy/MM")
    named = [number(c).alias(c) for c in ("assets", "equity", "profit", "bps", "eps", "roe", "roa")]
    return statements.where(F.col("year").rlike(r"^\d{4}/(0[1-9]|1[0-2])$")).select("code", F.last_day(month).alias("fiscal_end"), *named)


def as_of(events: DataFrame, statements: DataFrame, inclusive: bool = True, at: str = "fiscal_end") -> DataFrame:
    """Each event (id, code, date) with its code's latest statement, by the day `at`, up to (or before) its date; events without one are dropped.

    An equi-join on code with a bound on the date, then one row per event by
    max_by: partial maxima shrink the matches before the shuffle.
    """
    bound = F.col(at) <= F.col("date") if inclusive else F.col(at) < F.col("date")
    columns = [c for c in statements.columns if c != "code"]
    found = events.join(statements, "code").where(bound).groupBy(*events.columns).agg(F.max_by(F.struct(*columns), at).alias("s"))
    return found.select(*events.columns, "s.*")


def imputed(statements: DataFrame) -> DataFrame:
    """shares, and eps, roe, roa where they are missing and their denominator is positive."""
    fill = lambda c, top, below: F.coalesce(F.col(c), F.when(F.col(below) > 0, top / F.col(below))).alias(c)
    rows = statements.withColumn("shares", F.try_divide("equity", "bps"))
    kept = [c for c in rows.columns if c not in ("eps", "roe", "roa")]
    return rows.select(*kept, fill("eps", F.col("profit"), "shares"), fill("roe", 100 * F.col("profit"), "equity"), fill("roa", 100 * F.col("profit"), "assets"))


def ratios(rows: DataFrame, price: str = "price") -> DataFrame:
    """per, pbr, cap and cap_log of imputed rows with a price."""
    over = lambda c: F.when(F.col(c) > 0, F.col(price) / F.col(c))
    cap = F.col(price) * F.col("shares")
    return rows.select("*", over("eps").alias("per"), over("bps").alias("pbr"), cap.alias("cap"), F.log1p(cap).alias("cap_log"))


def statement_ratios(statements: DataFrame, price: str = "price") -> DataFrame:
    """eps, bps, per, pbr and cap of quarterly statements (eps, bps, equity, total_shares, treasury_shares as text) with a price.

    Blank is missing; treasury shares are 0 then. A missing bps is equity by outstanding shares.
    """
    n = {c: number(c) for c in ("eps", "bps", "equity", "total_shares", "treasury_shares")}
    shares = n["total_shares"] - F.coalesce(n["treasury_shares"], F.lit(0.0))
    bps = F.when(F.coalesce(F.trim("bps"), F.lit("")) == "", F.try_divide(n["equity"], shares)).otherwise(n["bps"])
    kept = [c for c in statements.columns if c not in n]
    rows = statements.select(*kept, n["eps"].alias("eps"), bps.alias("bps"), shares.alias("shares"))
    return rows.select(*kept, "eps", "bps", F.try_divide(price, "eps").alias("per"), F.try_divide(price, "bps").alias("pbr"), (F.col(price) * F.col("shares")).alias("cap"))
