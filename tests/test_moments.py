"""Least squares from moments: against numpy's least squares on each whole series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import Series
from tickloom.operators import moments, profile, segments

S = Series("symbol", "at")


def plain_adf(x):
    """(t statistic, lags) by least squares on the whole series, centred: the statistic doesn't feel the level, but the inverse's digits do."""
    x = x - x.mean()
    n, dx = len(x), np.diff(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(p, skip):
        y = dx[skip:]
        design = np.column_stack([x[skip:-1], np.ones(len(y)), *(dx[skip - j : len(dx) - j] for j in range(1, p + 1))])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rest = y - design @ beta
        sse = float(rest @ rest)
        cov = np.linalg.pinv(design.T @ design)[0, 0] * sse / max(1, len(y) - design.shape[1])
        return len(y) * math.log(sse / len(y)) + 2 * design.shape[1], float(beta[0] / math.sqrt(cov))

    best = min(range(most + 1), key=lambda p: fit(p, most)[0])
    return fit(best, best)[1], best


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(1)
    series = {"walk": 1000 + np.cumsum(rng.normal(size=900)), "noise": 50 + rng.normal(size=400), "short": rng.normal(size=25), "trend": np.arange(300) + rng.normal(size=300)}
    lagged = np.zeros(500)
    for t in range(3, 500):
        lagged[t] = 0.6 * lagged[t - 1] - 0.3 * lagged[t - 3] + rng.normal()
    series["lagged"] = 9e5 + 100 * lagged
    gaps = np.cumsum(rng.normal(size=240))
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("flat", t, 2.0) for t in range(60)] + [("few", t, float(t)) for t in range(5)] + [("gaps", t, None if t % 4 else float(gaps[t])) for t in range(240)]
    return {**series, "gaps": gaps[::4]}, spark.createDataFrame(rows, "symbol string, at long, close double").repartition(4)


@pytest.mark.parametrize("rows", [100, 10_000])
def test_dickey_fuller_equals_least_squares(walks, rows):
    series, frame = walks
    found = {r.symbol: r for r in profile.stationarity(frame, S, rows=rows).collect()}
    assert set(found) == {*series, "flat", "few"}
    for k, x in series.items():
        t, lags = plain_adf(x)
        assert found[k].n_lags == lags and found[k].adf_statistic == pytest.approx(t, rel=1e-9), k
        assert found[k].n_rows == len(x) and found[k].is_stationary == (t < found[k].critical_5)
    for k in ("flat", "few"):
        assert found[k].adf_statistic is None and found[k].n_lags is None and not found[k].is_stationary


def test_dickey_fuller_of_nothing(spark, walks):
    assert profile.stationarity(walks[1].limit(0), S).count() == 0
    assert [r.adf_statistic for r in profile.stationarity(walks[1].where("symbol = 'flat'"), S).collect()] == [None]


def test_moments_equal_products(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    rows = spark.createDataFrame([("ab"[k % 5 == 0], [float(v) for v in r]) for k, r in enumerate(x)] + [(None, [1.0, 2.0, 3.0, 4.0]), ("a", None)], "symbol string, row array<double>").repartition(6)
    found = {r.symbol: (r.n, np.array(r.moments).reshape(4, 4)) for r in moments.moments(rows, "symbol", "row").collect()}
    for k, name in enumerate("ab"):
        own = x[[i % 5 == 0 for i in range(500)]] if k else x[[i % 5 != 0 for i in range(500)]]
        assert found[name][0] == len(own) and np.allclose(found[name][1], own.T @ own, rtol=1e-12)
    assert found[None][0] == 1 and found[None][1][1, 3] == 8.0


def test_recent_values_reach_over_blocks(spark, walks):
    _, frame = walks
    b = segments.blocks_of(frame.where("symbol = 'walk'"), S, rows=60, reach=9)
    assert b.sizes.count() > 8
    for r in moments.recent(b, "close", 10, "seen").rows.orderBy("at").collect():
        assert r.seen == walks[0]["walk"][max(0, r["at"] - 9) : r["at"] + 1][::-1].tolist() and r.seen_at == r["at"] + 1


@pytest.mark.parametrize("name", ["arima", "seasonal_arima"])
def test_arima_from_moments_equals_the_whole_series(spark, name):
    """Each series' forecast is that of one array at a time; a short series says that it is."""
    from tickloom.operators import models

    rng = np.random.default_rng(5)
    series = {"a": 200 + np.cumsum(rng.normal(size=400)), "b": 90 + np.tile([0.0, 3, 1, 5, 2], 60) + rng.normal(size=300), "c": np.arange(7.0)}
    rows = [(k, t, float(v), 0.0, "train" if t < 0.8 * len(x) else "test") for k, x in series.items() for t, v in enumerate(x)]
    split = spark.createDataFrame(rows, "symbol string, at long, close double, target double, split string").repartition(3)
    (p, d, q), season, seasonal = models.ORDERS[name]
    for cut in (60, 10_000):
        out = models.arima_predict(split, name, s=S, rows=cut).orderBy("symbol", "at").collect()
        for k, x in series.items():
            own = [r for r in out if r.symbol == k]
            n = len(x) - len(own)
            assert n == math.ceil(0.8 * len(x))
            if k == "c":
                assert all(r.predicted is None and r.fit_error for r in own)
                continue
            path = np.concatenate([x[n - 1 : n], models.arima_forecast(x[:n], len(own), p, d, q, season, seasonal)])
            assert [r.predicted for r in own] == pytest.approx(list(path[1:] / path[:-1] - 1), rel=1e-5, abs=1e-7) and not any(r.fit_error for r in own)


def test_insensitive_regression_is_at_its_optimum(spark):
    """Each coefficient is the sum of the rows times multipliers: c outside the tube, none inside, at most c on its edge."""
    from tickloom.operators.models import fit_insensitive

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)])
    y = x @ np.array([1.0, -0.5, 0.0, 0.3]) + rng.standard_t(2, size=200) * 0.3
    rows = spark.createDataFrame([([*map(float, r), float(v)],) for r, v in zip(x, y, strict=True)], "row array<double>").repartition(3).cache()
    c, epsilon = 0.5, 0.2

    def objective(w):
        return w[:3] @ w[:3] / 2 + c * np.maximum(0, np.abs(y - x @ w) - epsilon).sum()

    w = fit_insensitive(rows, 4, c=c, epsilon=epsilon, tolerance=1e-9)
    e = y - x @ w
    edge = np.abs(np.abs(e) - epsilon) < 1e-3
    outside = (np.abs(e) > epsilon) & ~edge
    rest = np.append(w[:3], 0.0) - c * (np.sign(e[outside])[:, None] * x[outside]).sum(axis=0)
    on = x[edge] * np.sign(e[edge])[:, None]
    share, *_ = np.linalg.lstsq(on.T, rest, rcond=None)
    assert np.allclose(on.T @ share, rest, atol=0.02 * c) and len(share) >= 1
    best = min(objective(w + rng.normal(size=4) * s) for s in (1e-3, 1e-2, 0.1, 1) for _ in range(300))
    assert objective(w) <= best + 1e-4 and objective(w) < objective(np.zeros(4))
