"""Indicators against pandas, and by hand on series that are constant, rising or short."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.indicators import ewm_last, macd_last
from tidemark.operators import prices


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    rows = []
    for code, n in ((1, 1), (2, 13), (3, 14), (4, 20), (5, 240)):
        close = 100 + np.cumsum(rng.integers(-3, 4, n))
        for k in range(n):
            rows.append((code, date(2024, 1, 1) + timedelta(k), float(close[k] - 1), float(close[k] + rng.integers(0, 4)), float(close[k] - 2), float(close[k]), 10.0))
    rows += [(6, date(2024, 1, 1) + timedelta(k), 5.0, 5.0, 5.0, 5.0, 1.0) for k in range(30)]
    rows += [(7, date(2024, 1, 1) + timedelta(k), 5.0 + k, 5.0 + k, 5.0 + k, 5.0 + k, 1.0) for k in range(30)]
    return spark.createDataFrame(rows, "code long, date date, open double, high double, low double, close double, volume double")


def by_pandas(d: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=d.index)
    before, step = d.close.shift(1), d.close.diff()
    gain, loss = step.where(step > 0, 0).rolling(14).mean(), (-step).where(step < 0, 0).rolling(14).mean()
    out["rsi14"] = 100 - 100 / (1 + gain / loss)
    out["ma50"], out["ma200"] = d.close.rolling(50, min_periods=1).mean(), d.close.rolling(200, min_periods=1).mean()
    tr = pd.concat([d.high - d.low, (d.high - before).abs(), (d.low - before).abs()], axis=1).max(axis=1)
    out["tr"], out["atr14"] = tr, tr.rolling(14, min_periods=1).mean()
    mean, std = d.close.rolling(20).mean(), d.close.rolling(20).std()
    out["upper"], out["lower"] = mean + 2 * std, mean - 2 * std
    high, low = d.high.rolling(14).max(), d.low.rolling(14).min()
    out["pr14"] = 100 * (high - d.close) / (high - low)
    up, down = (d.high - d.high.shift(1)).clip(lower=0).fillna(0), (d.low.shift(1) - d.low).clip(lower=0).fillna(0)
    full = tr.rolling(14).mean()
    pdi, ndi = up.rolling(14).sum() / full * 100, down.rolling(14).sum() / full * 100
    out["adx14"] = ((pdi - ndi).abs() / (pdi + ndi)).rolling(14).mean() * 100
    out["change"] = d.close.pct_change() * 100
    return out


def test_equal_pandas(series):
    got = prices.with_indicators(series).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    for _, d in got.groupby("code"):
        want = by_pandas(d)
        for c in want:
            a, b = d[c].astype(float).to_numpy(), want[c].replace([np.inf, -np.inf], np.nan).to_numpy()
            assert np.allclose(a, b, equal_nan=True, atol=1e-9), (d.code.iloc[0], c)


def test_no_losses_and_no_moves(series):
    got = prices.with_indicators(series).where("code in (6, 7)").orderBy("code", "date").collect()
    assert {r.rsi14 for r in got if r.code == 6} == {None}
    assert [r.rsi14 for r in got if r.code == 7][-1] == 100


def test_weighted_means(series):
    got = {r.code: r for r in prices.closes(series).select("code", "closes", ewm_last(prices.F.col("closes"), 12).alias("e"), macd_last(prices.F.col("closes")).alias("m")).collect()}
    for r in got.values():
        s = pd.Series(r.closes)
        fast, slow = s.ewm(span=12, adjust=False).mean(), s.ewm(span=26, adjust=False).mean()
        assert math.isclose(r.e, fast.iloc[-1]) and math.isclose(r.m["slow"], slow.iloc[-1])
        assert math.isclose(r.m["signal"], (fast - slow).ewm(span=9, adjust=False).mean().iloc[-1], abs_tol=1e-9)


def test_targets_carry_forward(series):
    rows = prices.change_rates(series).select("code", "date", *prices.carried()).where("date = '2024-01-01'").collect()
    by = {r.code: r for r in rows}
    assert by[1].target_49 == by[1].target_0 and by[2].target_49 == by[2].target_7
    assert by[7].target_3 == pytest.approx(60.0)
