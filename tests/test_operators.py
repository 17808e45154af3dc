"""Features, risk, profile, evaluation, rules and models on hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_windows import bars, walk
from tickloom.functions.series import Series
from tickloom.operators import evaluate, features, indicators, models, profile, recommend, risk, views

S = Series()


@pytest.fixture(scope="module")
def split(spark):
    frame = indicators.indicator_frame(bars(spark, a=walk(502), b=walk(480, 3), short=walk(300, 4)))
    return features.time_split(features.feature_frame(frame)).cache()


def test_feature_rows_and_split(split):
    n = {(r.symbol, r.split): r["count"] for r in split.groupBy("symbol", "split").count().collect()}
    assert n == {("a", "train"): 202, ("a", "test"): 51, ("b", "train"): 184, ("b", "test"): 47}
    ends = split.groupBy("symbol").agg(F.max(F.when(F.col("split") == "train", F.col("dt"))).alias("x"), F.min(F.when(F.col("split") == "test", F.col("dt"))).alias("y")).collect()
    assert all(r.x < r.y for r in ends)
    assert len(features.FEATURES) == 37 and set(features.FEATURES) < set(split.columns)


def test_features_are_momenta_and_windows(split):
    f = split.toPandas()
    for k in features.MOMENTA:
        np.testing.assert_allclose(f[f"momentum_{k}"], f[f"roc_{k}"])
    for n in features.WINDOWS:
        assert (f[f"roll_min_{n}"] <= f[f"roll_mean_{n}"] + 1e-9).all() and (f[f"roll_mean_{n}"] <= f[f"roll_max_{n}"] + 1e-9).all()


def test_scaling_uses_train_rows_only(split):
    out = features.scaled(split).where("split = 'train'").toPandas()
    for c in features.FEATURES:
        for _, own in out.groupby("symbol"):
            assert abs(own[c].mean()) < 1e-7 and abs(own[c].std(ddof=0) - 1) < 1e-7
    held = features.scaler_parameters(split).where("symbol = 'a' AND feature = 'rsi'").first()
    train = split.where("symbol = 'a' AND split = 'train'").toPandas().rsi
    assert held["mean"] == pytest.approx(train.mean()) and held.scale == pytest.approx(train.std(ddof=0))


def returns(spark, **series):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if x is None else float(x)) for s, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, dt date, daily_return double")


def test_risk_matches_pandas(spark):
    x = pd.Series(np.random.default_rng(3).normal(0.001, 0.02, 300))
    r = risk.risk_profile(returns(spark, a=[None, *x])).first()
    grown = (1 + x).cumprod()
    assert r.n_returns == 300
    assert r.annual_volatility == pytest.approx(x.std() * 252**0.5 * 100)
    assert r.sharpe_ratio == pytest.approx((x.mean() * 252 - 0.02) / (x.std() * 252**0.5))
    assert r.sortino_ratio == pytest.approx((x.mean() * 252 - 0.02) / (x[x < 0].std() * 252**0.5))
    assert r.max_drawdown == pytest.approx(((grown - grown.cummax()) / grown.cummax() * 100).min())
    assert r.var_95 == pytest.approx(np.percentile(x, 5) * 100)
    assert r.cvar_95 == pytest.approx(x[x <= np.percentile(x, 5)].mean() * 100) and r.cvar_95 <= r.var_95


def test_risk_of_odd_series(spark):
    out = {r.symbol: r for r in risk.risk_profile(returns(spark, flat=[0] * 40, one_negative=[0.01] * 30 + [-0.01], few=[0.1] * 29)).collect()}
    assert set(out) == {"flat", "one_negative"}
    assert out["flat"].sharpe_ratio == 0 and out["flat"].sortino_ratio == 0 and out["flat"].max_drawdown == 0
    assert out["one_negative"].sortino_ratio == 0
    assert risk.risk_profile(returns(spark).where("false") if False else returns(spark, x=[1]).where("false")).count() == 0


def test_stationarity(spark):
    rng = np.random.default_rng(7)
    noise, steps = 100 + rng.normal(0, 1, 400), 100 + np.cumsum(rng.normal(0, 1, 400))
    out = {r.symbol: r for r in profile.stationarity(bars(spark, noise=noise, steps=steps, flat=[5] * 50, few=[1, 2, 3])).collect()}
    assert out["noise"].is_stationary and not out["steps"].is_stationary
    assert not out["flat"].is_stationary and out["few"].adf_statistic is None


def test_trend_and_season(spark):
    x = np.full(400, 100.0)
    x[-60:] = 150.0
    weekly = [100.0 + 20 * (i % 7) for i in range(400)]
    df = bars(spark, up=x, weekly=weekly, short=x[:100]).withColumn("daily_return", S.pct_change("close"))
    out = {r.symbol: r for r in profile.series_profile(df).collect()}
    assert out["up"].signed_trend == pytest.approx(0.5) and out["up"].has_strong_trend
    assert out["weekly"].has_seasonality and not out["short"].has_seasonality and not out["short"].has_strong_trend
    parts = profile.trend(df).join(profile.seasonality(df), "symbol").collect()
    for r in parts:
        for c in ("signed_trend", "trend_strength", "weekly_variation"):
            assert (getattr(r, c) is None) == (getattr(out[r.symbol], c) is None) and getattr(out[r.symbol], c) == (None if getattr(r, c) is None else pytest.approx(getattr(r, c)))
    every = {r.symbol: r for r in profile.characteristics(df).collect()}
    tested = {r.symbol: r.is_stationary for r in profile.stationarity(df).collect()}
    assert {k: r.is_stationary for k, r in every.items()} == tested and every["weekly"].has_seasonality


def test_profile_of_odd_series(spark):
    df = bars(spark, one=[5.0], few=[1.0, 2.0]).withColumn("daily_return", S.pct_change("close"))
    nothing = df.withColumns({"symbol": F.lit("nothing"), "close": F.lit(None).cast("double"), "daily_return": F.lit(None).cast("double")})
    out = {r.symbol: r for r in profile.series_profile(df.unionByName(nothing)).collect()}
    assert set(out) == {"one", "few", "nothing"} and all(r.trend_strength is None and not r.has_seasonality and not r.is_high_volatility for k, r in out.items() if k != "few")
    assert out["one"].weekly_variation is None and out["few"].weekly_variation == pytest.approx(np.std([1, 2], ddof=1) / 1.5)
    assert profile.series_profile(df.where("false")).count() == 0


def predictions(spark, rows):
    return spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), m, "ML", o, float(x), float(y)) for m, o, xs, ys in rows for i, (x, y) in enumerate(zip(xs, ys))],
                                 "symbol string, dt date, model string, type string, ord int, actual double, predicted double")


def test_metrics_and_champion(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    df = predictions(spark, [("mean", 0, x, [2.5] * 4), ("right", 1, x, x), ("right_too", 2, x, x), ("wrong", 3, x, x[::-1])])
    m = evaluate.model_metrics(df)
    out = {r.model: r for r in m.collect()}
    assert out["right"].r2 == 1 and out["mean"].r2 == pytest.approx(0) and out["wrong"].r2 < 0 and out["mean"].mae == 1
    assert evaluate.champion(m).first().model == "right"
    assert [r.model for r in evaluate.leaderboard(m).orderBy("rank").collect()] == ["right", "right_too", "mean", "wrong"]
    best, joined = (sorted(x.collect()) for x in (evaluate.best_predictions(df), evaluate.champion_series(df, evaluate.champion(m))))
    assert best == joined and len(best) == 4 and {r.model for r in best} == {"right"}
    assert {r.tier for r in evaluate.leaderboard(m).collect()} == {"Excellent", "Fair"}
    assert evaluate.preview(df, rows=2).count() == 2 and evaluate.preview_metrics(df, rows=3).first().n == 3
    assert {r.type: r.n_models for r in evaluate.training_summary(m).collect()} == {"ML": 4, "ALL": 4}


RULE = "case_id int, best_r2 double, sharpe_ratio double, sortino_ratio double, annual_volatility double, max_drawdown double, has_strong_trend boolean, is_high_volatility boolean"


@pytest.mark.parametrize("row, score, label", [
    ((0.71, 1.6, 1.6, 19.0, -14.0, True, False), 14, "STRONG BUY"),
    ((0.7, 1.5, 1.5, 20.0, -15.0, False, False), 5, "BUY"),
    ((0.4, 0.5, 1.5, 35.0, -25.0, False, False), 0, "REDUCE"),
    ((0.0, 0.0, 0.0, 90.0, -90.0, True, True), -2, "SELL"),
    ((None, 9.0, 9.0, 1.0, 0.0, True, False), None, "HOLD"),
    ((0.9, None, None, None, None, None, None), None, "HOLD"),
])
def test_rules(spark, row, score, label):
    out = recommend.recommend(spark.createDataFrame([(1, *row)], RULE)).first()
    assert (out.score, out.label) == (score, label)
    assert (out.reasoning == "Insufficient data") == (score is None)
    assert out.reasoning.count(" | ") <= 3


def test_views_of_short_series(spark):
    frame = indicators.indicators(bars(spark, a=walk(300), b=walk(5)))
    assert views.tail(frame).groupBy("symbol").count().where("symbol = 'b'").first()["count"] == 5
    out = {r.symbol: r for r in views.header_metrics(frame).collect()}
    assert out["a"].trailing_return == pytest.approx((walk(300)[-1] / walk(300)[-252] - 1) * 100)
    assert out["b"].trailing_return == pytest.approx((walk(5)[-1] / walk(5)[0] - 1) * 100)


def test_models_repeat_and_cover_the_test_rows(split):
    data = features.scaled(split).cache()
    n = data.where("split = 'test'").count()
    boosted = [lambda n=n: models.fit_predict(data, n, trees=1) for n in models.BOOSTED]
    networks = [lambda n=n: models.network_predict(data, n, epochs=1) for n in models.NETWORKS]
    for make in (*boosted, *networks, lambda: models.kernel_predict(data), lambda: models.fit_predict(data, "random_forest", trees=2), lambda: models.arima_predict(split), lambda: models.arima_predict(split, "seasonal_arima")):
        one, two = (make().orderBy("symbol", "dt").toPandas() for _ in range(2))
        assert len(one) == n and np.isfinite(one.predicted).all()
        pd.testing.assert_frame_equal(one, two)


def test_merged_families(split):
    both = evaluate.merged(evaluate.baseline_predictions(split), models.arima_predict(split, ord_=11))
    m = evaluate.model_metrics(both)
    assert {r.type for r in evaluate.leaderboard(m).collect()} == {"ML", "TS"} and {r.type for r in evaluate.leaderboard(m, without=("TS",)).collect()} == {"ML"}
    assert m.count() == 2 * 5


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 0.5 * x[:, 0] - 0.2 * x[:, 1]
    w = models.train_network(x, y, (16,), 60)
    assert np.mean((models.network_layers(w, x)[-1][:, 0] - y) ** 2) < 0.01


def test_arima_continues_a_trend():
    x = np.arange(100.0) + np.random.default_rng(0).normal(0, 0.01, 100)
    np.testing.assert_allclose(models.arima_forecast(x, 5, 2, 1, 1), 100 + np.arange(5), atol=0.2)
    week = np.tile([0.0, 5, 1, 4, 2], 30) + np.random.default_rng(1).normal(0, 0.01, 150)
    np.testing.assert_allclose(models.arima_forecast(week, 5, 1, 0, 1, 5), [0, 5, 1, 4, 2], atol=0.2)


def test_failed_fit_is_reported(spark, split):
    few = split.where("symbol = 'a'").orderBy("dt").limit(3).withColumn("split", F.lit("test"))
    out = models.arima_predict(few).collect()
    assert out and all(r.predicted is None and r.fit_error for r in out)
    scaled = features.scaled(few).na.fill(0.0)
    for made in (models.fit_predict(scaled, "random_forest", trees=1), models.fit_predict(scaled, "boosting_deep", trees=1), models.kernel_predict(scaled)):
        out = made.collect()
        assert len(out) == 3 and all(r.predicted is None and r.fit_error for r in out)
    assert evaluate.merged(made, evaluate.baseline_predictions(few)).where("model = 'kernel_rff'").count() == 0


def test_queries_run_presets(monkeypatch):
    from tickloom.operators import evaluate, models
    from tickloom.plans import registry

    asked = []
    for name in ("fit_predict", "kernel_predict", "network_predict", "arima_predict"):
        monkeypatch.setattr(models, name, lambda df, *args, _f=name, **kw: asked.append((_f, args, {k for k in kw if k != "ord_"})) or df)
    monkeypatch.setattr(registry, "_split", lambda s, d: None)
    monkeypatch.setattr(registry.features, "scaled", lambda df: None)
    monkeypatch.setattr(registry, "tidy", lambda df: df)
    monkeypatch.setattr(registry, "kept", lambda df, what: df)
    monkeypatch.setattr(models, "together", lambda fits: [fit() for fit in fits])
    for name in ("baseline_predictions", "model_metrics", "leaderboard"):
        monkeypatch.setattr(evaluate, name, lambda df: df)
    monkeypatch.setattr(evaluate, "merged", lambda *dfs: None)
    for name in ("rf_predictions", "svr_rff_predictions", *(f"{n}_predictions" for n in models.BOOSTED), *(f"network_{n}_predictions" for n in models.NETWORKS)):
        registry.queries()[name](None, "")
    assert all(not kw and all(isinstance(a, str) for a in args) for _, args, kw in asked), asked
    alone = {(f, args) for f, args, _ in asked} | {("arima_predict", (n,)) for n in models.ORDERS}
    asked.clear()
    registry.queries()["model_zoo_leaderboard"](None, "")
    assert {(f, args) for f, args, _ in asked} == alone and all(not kw for *_, kw in asked)


def test_seasonal_arima_has_seasonal_terms():
    from tickloom.operators import models

    assert models._lags(2, 1, 5) == [1, 2, 5, 6, 7] and models._lags(5, 0, 0) == [1, 2, 3, 4, 5]
    rng = np.random.default_rng(3)
    v, e = np.zeros(3000), rng.normal(size=3000)
    for t in range(5, 3000):
        v[t] = 0.6 * v[t - 5] + e[t]
    (p, d, q), season, seasonal = models.ORDERS["seasonal_arima"]
    ar, ma, *_ = models._arma(v, models._lags(p, seasonal[0], season), [])
    assert abs(ar[2] - 0.6) < 0.06 and abs(ar[[0, 1, 3, 4]]).max() < 0.06
    x = v
    for _ in range(d):
        x = np.cumsum(x)
    whole = np.concatenate([np.zeros(season), x])
    for t in range(season, len(whole)):
        whole[t] += whole[t - season]
    one = [abs(models.arima_forecast(whole[:n], 1, p, d, q, season, s)[0] - whole[n]) for s in ((0, 0), seasonal) for n in range(2000, 2060)]
    assert np.mean(one[60:]) < np.mean(one[:60])
