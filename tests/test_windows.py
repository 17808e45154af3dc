"""Column builders against pandas, on series with ties, flat stretches, zeros and few rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import Series
from tickloom.operators import indicators
from tickloom.operators.ewm import ewm_means

S = Series()
COLUMNS = "symbol string, dt date, open double, high double, low double, close double, volume double"


def bars(spark, **series):
    """A series for each name, of its closes; rows in no order."""
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c, c, c, 100.0 + i % 7) for s, closes in series.items() for i, c in enumerate(map(float, closes))]
    np.random.default_rng(1).shuffle(rows := [tuple(r) for r in rows])
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def walk(n, seed=0):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.02, n))) * 100


def got(df, column, symbol="a"):
    out = df.where(F.col("symbol") == symbol).select("dt", column).toPandas().sort_values("dt")
    return out[column].astype(float).to_numpy()


CASES = {
    "lag": (lambda: S.lag("close", 3), lambda x: x.shift(3)),
    "lead": (lambda: S.lead("close"), lambda x: x.shift(-1)),
    "diff": (lambda: S.diff("close"), lambda x: x.diff()),
    "pct": (lambda: S.pct_change("close", 5), lambda x: x.pct_change(5)),
    "mean": (lambda: S.rolling(F.avg, "close", 20), lambda x: x.rolling(20).mean()),
    "std": (lambda: S.rolling(F.stddev_samp, "close", 10), lambda x: x.rolling(10).std()),
    "min": (lambda: S.rolling(F.min, "close", 5), lambda x: x.rolling(5).min()),
    "max": (lambda: S.rolling(F.max, "close", 50), lambda x: x.rolling(50).max()),
    "peak": (lambda: S.expanding(F.max, "close"), lambda x: x.cummax()),
    "number": (lambda: S.number(), lambda x: pd.Series(range(1, len(x) + 1))),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("n", [1, 4, 80])
def test_matches_pandas(spark, name, n):
    mine, theirs = CASES[name]
    df = bars(spark, a=walk(n), b=walk(n, 2))
    for symbol, seed in (("a", 0), ("b", 2)):
        np.testing.assert_allclose(got(df.select("symbol", "dt", mine().alias("x")), "x", symbol), theirs(pd.Series(walk(n, seed))).astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("span", [1, 2, 9, 26, 400])
def test_exponential_means(spark, span):
    x = walk(1500)
    np.testing.assert_allclose(got(ewm_means(bars(spark, a=x, b=x[:3]), {"e": ("close", span)}), "e"), pd.Series(x).ewm(span=span).mean(), rtol=1e-11)


def test_exponential_mean_of_nulls_and_extra_columns(spark):
    df = bars(spark, a=walk(30)).withColumn("x", F.when(F.dayofmonth("dt") % 4 != 0, F.col("close"))).withColumn("e_at", F.lit(1))
    x = pd.Series(got(df, "x"))
    np.testing.assert_allclose(got(ewm_means(df, {"e": ("x", 5)}), "e"), x.ewm(span=5).mean(), rtol=1e-12)
    assert ewm_means(df, {}).columns == df.columns


def test_compounding_skips_nulls(spark):
    df = bars(spark, a=walk(40)).withColumn("r", S.pct_change("close"))
    out = got(df.select("symbol", "dt", S.compounded("r").alias("x")), "x")
    assert np.isnan(out[0])
    np.testing.assert_allclose(out[1:], walk(40)[1:] / walk(40)[0], rtol=1e-12)


def test_zero_base_is_null(spark):
    out = got(bars(spark, a=[0, 5, 10]).select("symbol", "dt", S.pct_change("close").alias("x")), "x")
    assert np.isnan(out[1]) and out[2] == 1


def test_rsi_of_extremes(spark):
    df = indicators.add_rsi(bars(spark, up=range(1, 60), down=range(60, 1, -1), flat=[7] * 60))
    assert set(got(df, "rsi", "up")[14:]) == {100.0} and set(got(df, "rsi", "down")[14:]) == {0.0}
    assert np.isnan(got(df, "rsi", "flat")).all()
    assert np.isnan(got(df, "rsi", "up")[:13]).all() and got(df, "rsi", "up")[13] == 100


@pytest.mark.parametrize("n, left", [(12, 0), (199, 0), (200, 1), (251, 52)])
def test_warm_up(spark, n, left):
    assert indicators.indicator_frame(bars(spark, a=walk(n))).count() == left


def test_flat_gap_removes_rows_inside(spark):
    x = walk(500)
    x[300:317] = x[300]
    frame = indicators.indicator_frame(bars(spark, a=x))
    assert frame.count() == 301 - 3


def test_bounds_of_indicators(spark):
    f = indicators.indicator_frame(bars(spark, a=walk(400), b=walk(400, 5))).toPandas()
    assert (f.bb_upper >= f.bb_middle).all() and (f.bb_middle >= f.bb_lower).all() and f.rsi.between(0, 100).all()
    first = {"a": walk(400)[0], "b": walk(400, 5)[0]}
    np.testing.assert_allclose(f.cumulative_return, f.close / f.symbol.map(first), rtol=1e-9)
    np.testing.assert_allclose(f.macd, f.ema_12 - f.ema_26, atol=1e-9)


def test_one_exchange(spark):
    plan = indicators.indicators(bars(spark, a=walk(10)).repartition(2))._jdf.queryExecution().optimizedPlan()
    text = indicators.indicators(bars(spark, a=walk(10)))._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(symbol") == 1, plan
