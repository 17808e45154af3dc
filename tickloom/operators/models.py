"""Forecasting models over scaled features(symbol, dt, split, FEATURES, target): predictions of the test rows.

Forests are Spark ML estimators and boosted trees `boosting`'s, over the whole table, and kernel regression is fitted from moments of all its rows, so a panel of many
series is one fit. Autoregressions are fitted from moments that all tasks add to. A network fits each series in a task of its
own: bars, not ticks, so a series is a bounded group. Presets are the sizes, and queries use them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from ..sources.scratch import kept
from . import boosting
from .boosting import Growth
from .features import FEATURES
from .moments import lag_rows, moments, recent, solve
from .segments import ROWS, blocks_of, running

S = Series()
SEED = 42
#: First-order boosted ensembles by name: trees, learning rate, depth. Fixed values.
BOOSTED = {"gradient_boosting": (100, 0.1, 3), "boosting_deep": (200, 0.05, 8), "boosting_leafwise": (200, 0.05, 5), "boosting_symmetric": (200, 0.05, 6)}
#: How the ensembles of `boosting` grow, by name. Fixed values.
GROWN = {
    "second_order_boosting": Growth(200, 0.05, depth=8, penalty=1.0), "leafwise_boosting": Growth(200, 0.05, leaves=31, least=20),
    "symmetric_boosting": Growth(200, 0.05, depth=6, penalty=3.0, symmetric=True, bins=254),
}
FOREST_TREES, FOREST_DEPTH = 200, 10
PREDICTIONS = "model string, type string, ord int"


def growth(name: str, trees: int | None = None) -> Growth | None:
    """How the ensemble of a name grows, with its own number of trees unless another is given; None for a forest.

    First-order ensembles grow as Spark ML's gradient-boosted trees do: 32 bins, leaves of one row or more without a penalty, a first tree of full weight, and later
    ones on the gradients of squared errors, which are twice the residuals.
    """
    if name in BOOSTED:
        n, rate, depth = BOOSTED[name]
        return Growth(trees or n, 2 * rate, depth=depth, bins=31, first=1.0)
    return replace(GROWN[name], trees=trees or GROWN[name].trees) if name in GROWN else None


def estimator(trees: int | None = None) -> Estimator:
    """The Spark ML estimator of the forest, with its own number of trees unless another is given."""
    return RandomForestRegressor(labelCol="target", numTrees=trees or FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED, featureSubsetStrategy="all")


def _fit(kind: Estimator, vectors: DataFrame) -> Model:
    """Fit on the train rows, kept meanwhile: an estimator reads them several times."""
    train = vectors.where(F.col("split") == "train").select("features", "target").persist()
    try:
        if train.isEmpty():
            raise ValueError("no train rows")
        return kind.fit(train)
    finally:
        train.unpersist()


def _tested(vectors: DataFrame, predict: Callable[[DataFrame], DataFrame], name: str, ord_: int, s: Series) -> DataFrame:
    """predict(test rows): they with prediction. Where a model can't be fitted, for whatever reason, they are null and fit_error says why: one model's failure leaves the
    others be."""
    test, error = vectors.where(F.col("split") == "test"), None
    try:
        out = predict(test)
    except Exception as e:  # noqa: BLE001
        out, error = test.withColumn("prediction", F.lit(None).cast("double")), f"{type(e).__name__}: {e}"[:1000]
    return out.select(
        s.key, s.order, F.lit(name).alias("model"), F.lit("ML").alias("type"), F.lit(ord_).alias("ord"), F.col("target").alias("actual"), F.col("prediction").alias("predicted"),
        F.lit(error).cast("string").alias("fit_error"),
    )


def fit_predict(scaled: DataFrame, name: str, trees: int | None = None, ord_: int = 0, s: Series = S, columns: list[str] | None = None) -> DataFrame:
    """Fit a tree ensemble on the train rows of all series; predict the test rows."""
    names = columns or FEATURES
    if grows := growth(name, trees):

        def grown(_: DataFrame) -> DataFrame:
            # written once: train and test rows share the work that features take
            whole = kept(scaled.select(s.key, s.order, "split", "target", *names), "scaled")
            return boosting.predict(whole.where(F.col("split") == "test"), boosting.fit(whole.where(F.col("split") == "train"), names, grows), [s.key, s.order, "target"])

        return _tested(scaled, grown, name, ord_, s)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    return _tested(vectors, lambda test: _fit(estimator(trees), vectors).transform(test), name, ord_, s)


def kernel_waves(scaled: DataFrame, n_features: int, names: list[str]) -> Column:
    """Random Fourier features of the RBF kernel (Rahimi & Recht 2007), as an array of cosines, and a one."""
    rng = np.random.default_rng(SEED)
    weights, shifts = rng.normal(0, math.sqrt(2 / len(names)), (n_features, len(names))), rng.uniform(0, 2 * math.pi, n_features)
    waves = F.transform(
        F.lit([[*map(float, w), float(b)] for w, b in zip(weights, shifts, strict=True)]),
        lambda w: F.cos(F.aggregate(F.zip_with(F.array(*names, F.lit(1.0)), w, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)) * math.sqrt(2 / n_features),
    )
    return F.concat(waves, F.array(F.lit(1.0)))


def fit_insensitive(rows: DataFrame, width: int, *, c: float = 1.0, epsilon: float = 0.1, rounds: int = 60, tolerance: float = 1e-6) -> np.ndarray:
    """w of the least |w|^2 / 2 + c * sum(max(0, |y - w x| - epsilon)) over rows(row: the array [*x, y], x of `width` numbers, the last one a constant that
    isn't penalised): support vector regression in its primal form.

    Rounds of reweighted least squares (Perez-Cruz et al. 2000): a row outside the tube weighs c over its distance to it, a row inside nothing, and a
    round is one table of moments that all tasks add to; the step is halved until the objective, one aggregate more, doesn't grow.
    """
    sure = np.diag([1.0] * (width - 1) + [1e-9])
    predicted = lambda w: F.aggregate(F.zip_with(F.slice("row", 1, width), F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    error = lambda w: F.get(F.col("row"), F.lit(width)) - predicted(w)

    def objective(w: np.ndarray) -> float:
        lost = rows.agg(F.sum(F.greatest(F.abs(error(w)) - epsilon, F.lit(0.0)))).first()[0] or 0.0
        return float(w @ sure @ w) / 2 + c * lost

    w = np.zeros(width)
    best = objective(w)
    for _ in range(rounds):
        away = F.abs(F.col("e")) - epsilon
        # outside, the target is the tube's edge; the weight's root scales the row
        root, edge = F.sqrt(c / F.greatest(away, F.lit(1e-6))), F.signum("e") * epsilon
        weighed = rows.withColumn("e", error(w)).where(away > 0).withColumn("weighed", F.transform("row", lambda x, k: F.when(k == width, x - edge).otherwise(x) * root))
        found = moments(weighed.withColumn("key", F.lit(0)), "key", "weighed").first()
        gram = np.zeros((width + 1, width + 1)) if found is None else np.array(found.moments).reshape(width + 1, width + 1)
        step = np.linalg.solve(gram[:width, :width] + sure, gram[:width, width]) - w
        size = 1.0
        while size > 1e-4 and (now := objective(w + size * step)) > best:
            size /= 2
        if size <= 1e-4 or best - now <= tolerance * max(1.0, best):
            return w + size * step if size > 1e-4 else w
        w, best = w + size * step, now
    return w


def kernel_predict(scaled: DataFrame, n_features: int = 64, c: float = 1.0, epsilon: float = 0.1, ord_: int = 0, s: Series = S, columns: list[str] | None = None) -> DataFrame:
    """Support vector regression with an RBF kernel in its random Fourier features: the loss is insensitive below epsilon deviations of the train rows'
    targets, as are c and epsilon measured in them."""
    rows = scaled.select(s.key, s.order, "split", "target", kernel_waves(scaled, n_features, columns or FEATURES).alias("waves"))
    train, error, predicted = rows.where(F.col("split") == "train"), None, F.lit(None).cast("double")
    try:
        mean, dev, n = train.agg(F.avg("target"), F.stddev_pop("target"), F.count("target")).first()
        if not n:
            raise ValueError("no train rows")
        dev = dev or 1.0
        fitted = kept(train.select(F.concat("waves", F.array((F.col("target") - mean) / dev)).alias("row")), "train")
        w = fit_insensitive(fitted, n_features + 1, c=c, epsilon=epsilon)
        predicted = F.aggregate(F.zip_with("waves", F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) * dev + mean
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"[:1000]
    test = rows.where(F.col("split") == "test")
    return test.select(
        s.key, s.order, F.lit("kernel_rff").alias("model"), F.lit("ML").alias("type"), F.lit(ord_).alias("ord"), F.col("target").alias("actual"), predicted.alias("predicted"),
        F.lit(error).cast("string").alias("fit_error"),
    )


def together(fits: list[Callable[[], DataFrame]], workers: int = 6) -> list[DataFrame]:
    """Each fit's predictions as a table of its own. The fits run side by side: a model's jobs are many and small, and wait for one
    another, so that one model alone leaves most of a cluster idle."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(lambda fit: kept(fit(), "predictions"), fits))


def _by_series(rows: DataFrame, fit: Callable[[pd.DataFrame], np.ndarray], name: str, kind: str, ord_: int, s: Series) -> DataFrame:
    """Predictions of fit(series in order) for its test rows; a series whose fit fails has null predictions and says why."""
    key, order = (rows.schema[c].dataType.simpleString() for c in (s.key, s.order))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(s.order, ignore_index=True)
        test = (group["split"] == "test").to_numpy()
        out = group.loc[test, [s.key, s.order, "target"]].rename(columns={"target": "actual"})
        try:
            out["predicted"], out["fit_error"] = fit(group), None
        except Exception as e:  # noqa: BLE001
            out["predicted"], out["fit_error"] = np.nan, f"{type(e).__name__}: {e}"[:1000]
        return out

    made = rows.groupBy(s.key).applyInPandas(run, f"`{s.key}` {key}, `{s.order}` {order}, actual double, predicted double, fit_error string")
    return made.select(s.key, s.order, F.lit(name).alias("model"), F.lit(kind).alias("type"), F.lit(ord_).alias("ord"), "actual", F.nanvl("predicted", F.lit(None).cast("double")).alias("predicted"), "fit_error")


#: Networks by name: hidden units of each layer, epochs. Fixed values.
NETWORKS = {"gated_3": ((100, 50, 25), 30), "bidirectional": ((64, 32), 30), "gated_2": ((100, 50), 30), "plain_2": ((100, 50), 25), "convolution": ((64, 32, 50), 30)}


def train_network(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...], epochs: int, batch: int = 32, rate: float = 1e-3) -> list[np.ndarray]:
    """Weights of a feed-forward network of tanh layers, by Adam on squared errors."""
    rng = np.random.default_rng(SEED)
    sizes = [x.shape[1], *hidden, 1]
    w = [a for m, n in zip(sizes[:-1], sizes[1:], strict=True) for a in (rng.normal(0, math.sqrt(1 / m), (m, n)), np.zeros(n))]
    m1, m2, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            xs, ys = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
            layers = network_layers(w, xs)
            back = 2 * (layers[-1] - ys[:, None]) / len(xs)
            grads: list[np.ndarray] = []
            for k in range(len(w) - 2, -1, -2):
                below = layers[k // 2]
                grads = [below.T @ back, back.sum(axis=0), *grads]
                back = (back @ w[k].T) * (1 - below**2)
            t += 1
            for a, g, p, q in zip(w, grads, m1, m2, strict=True):
                p += 0.1 * (g - p)
                q += 0.001 * (g * g - q)
                a -= rate * (p / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-7)
    return w


def network_layers(w: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    for k in range(0, len(w), 2):
        z = out[-1] @ w[k] + w[k + 1]
        out.append(z if k == len(w) - 2 else np.tanh(z))
    return out


def network_predict(scaled: DataFrame, name: str = "plain_2", epochs: int | None = None, ord_: int = 0, s: Series = S, columns: list[str] | None = None) -> DataFrame:
    """A network for each series. With sequences of one step, as these features are, recurrent cells have nothing to
    recur on; the presets keep their layers' sizes and epochs as feed-forward layers."""
    hidden, own = NETWORKS[name]
    names = columns or FEATURES

    def fit(group: pd.DataFrame) -> np.ndarray:
        train = (group["split"] == "train").to_numpy()
        x, y = group[names].to_numpy(float), group["target"].to_numpy(float)
        w = train_network(x[train], y[train], hidden, epochs or own)
        return network_layers(w, x[~train])[-1][:, 0]

    return _by_series(scaled.select(s.key, s.order, "split", "target", *names), fit, name, "DL", ord_, s)


def _lags(n: int, seasonal: int, season: int) -> list[int]:
    """The lags of a polynomial of n terms times a seasonal one."""
    return sorted({j + season * k for k in range(seasonal + 1) for j in range(n + 1)} - {0})


def _arma(x: np.ndarray, p: list[int], q: list[int]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(ar, ma, constant, residuals) of the lags p and q by Hannan-Rissanen: residuals of a long autoregression stand in
    for the shocks. Coefficients of product lags are free."""
    def lags(v: np.ndarray, of: list[int] | range, start: int) -> list[np.ndarray]:
        return [v[start - j : len(v) - j] for j in of]

    most_p, most_q = max(p, default=0), max(q, default=0)
    long = min(len(x) // 4, max(most_p, most_q) + 10)
    if long < 1:
        raise ValueError("the series is too short")
    design = np.column_stack([np.ones(len(x) - long), *lags(x, range(1, long + 1), long)])
    beta, *_ = np.linalg.lstsq(design, x[long:], rcond=None)
    shocks = np.concatenate([np.zeros(long), x[long:] - design @ beta])
    start = max(long + most_q, most_p)
    if start >= len(x):
        raise ValueError("the series is too short")
    design = np.column_stack([np.ones(len(x) - start), *lags(x, p, start), *lags(shocks, q, start)])
    beta, *_ = np.linalg.lstsq(design, x[start:], rcond=None)
    return beta[1 : 1 + len(p)], beta[1 + len(p) :], float(beta[0]), shocks


def _continued(beta: np.ndarray, ps: list[int], qs: list[int], past: list[float], noise: list[float], steps: int) -> np.ndarray:
    """The next values of a series of coefficients [constant, *ar, *ma]; past and noise hold the last values and shocks, the newest first."""
    constant, ar, ma = beta[0], beta[1 : 1 + len(ps)], beta[1 + len(ps) :]
    longest = max(ps, default=1), max(qs, default=1)
    values, shocks = [*past[: longest[0]][::-1]], [*noise[: longest[1]][::-1], *[0.0] * steps]
    for k in range(steps):
        values.append(constant + sum(a * values[-j] for a, j in zip(ar, ps, strict=True)) + sum(a * shocks[longest[1] + k - j] for a, j in zip(ma, qs, strict=True)))
    return np.array(values[longest[0] :])


def _undone(done: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Values whose differences are `done`; parts: (lag, last values before) of each difference taken, in order."""
    for back, last in reversed(parts):
        whole = np.concatenate([last, np.zeros(len(done))])
        for i in range(len(done)):
            whole[back + i] = done[i] + whole[i]
        done = whole[back:]
    return done


def _differenced(x: np.ndarray, d: int, season: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    parts = []
    for back in ([season] if season else []) + [1] * d:
        parts.append((back, x[-back:]))
        x = x[back:] - x[:-back]
    return x, parts


def arima_forecast(x: np.ndarray, steps: int, p: int, d: int, q: int, season: int = 0, seasonal: tuple[int, int] = (0, 0)) -> np.ndarray:
    """The next values of one array by an ARIMA(p, d, q), after one seasonal difference if season is given, with seasonal AR
    and MA terms. A model that explodes gives values beyond doubles in the end."""
    v, parts = _differenced(x, d, season)
    ps, qs = _lags(p, seasonal[0], season), _lags(q, seasonal[1], season)
    ar, ma, constant, shocks = _arma(v, ps, qs)
    with np.errstate(over="ignore", invalid="ignore"):
        return _undone(_continued(np.array([constant, *ar, *ma]), ps, qs, v[::-1].tolist(), shocks[::-1].tolist(), steps), parts)


#: Orders (p, d, q), season and seasonal terms (AR, MA) of the price models. Fixed values.
ORDERS = {"arima": ((5, 1, 2), 0, (0, 0)), "seasonal_arima": ((2, 1, 2), 5, (1, 1))}


def arima_predict(split: DataFrame, name: str = "arima", ord_: int = 0, s: Series = S, rows: int = ROWS) -> DataFrame:
    """Returns implied by a price forecast over each series' test rows, of a model of its train prices alone.

    Hannan-Rissanen in two regressions from moments over the series' blocks: a long autoregression, whose residuals stand in for the
    shocks, and then lags of values and shocks. What is left for one task is a series' coefficients and last values, from which
    the forecast is a recursion over its test rows. A series that is too short has null predictions and says so; so has, without a
    reason, a step that is beyond doubles.
    """
    (p, d, q), season, seasonal = ORDERS[name]
    ps, qs = _lags(p, seasonal[0], season), _lags(q, seasonal[1], season)
    poly = np.array([1.0])
    for back in ([season] if season else []) + [1] * d:
        poly = np.convolve(poly, [1.0, *[0.0] * (back - 1), -1.0])
    lost, top_p, top_q = len(poly) - 1, max(ps, default=0), max(qs, default=0)
    most = max(top_p, top_q) + 10
    key, order = (split.schema[c].dataType.simpleString() for c in (s.key, s.order))
    on = lambda df, few: df.join(few, F.col(s.key).eqNullSafe(F.col("_key")))
    named = lambda c: F.col(c).alias("_key")

    train = split.where((F.col("split") == "train") & F.col("close").isNotNull()).select(s.key, s.order, F.col("close").cast("double").alias("_x"))
    size = train.groupBy(named(s.key)).agg((F.count("*") - lost).alias("_m")).withColumn("_long", F.least(F.floor(F.col("_m") / 4), F.lit(most)).cast("int"))
    size = size.withColumn("_start", F.greatest(F.col("_long") + top_q, F.lit(top_p)))
    size = kept(size.where((F.col("_long") >= 1) & (F.col("_start") < F.col("_m"))), "sizes")
    seen = recent(blocks_of(on(train, size).drop("_key", "_m"), s, rows=rows, reach=lost + most), "_x", lost + most + 1, "_seen")
    value = lambda k: sum((F.get(F.col("_seen"), k + i) * float(c) for i, c in enumerate(poly) if c), F.lit(0.0))
    made = seen.frame.withColumns({"_v": F.transform(F.sequence(F.lit(0), F.lit(most)), value), "_t": F.col("_seen_at") - 1 - lost})

    def solved(table: DataFrame, width: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"_key": f["_key"], "_beta": [solve(np.asarray(g).reshape(width, width), width - 1, width - 1)[0].tolist() for g in f["moments"]]})

        return kept(table.select(named(s.key), "moments").mapInPandas(run, f"_key {key}, _beta array<double>"), "coefficients")

    first = made.withColumn("_row", F.when(F.col("_t") >= F.col("_long"), lag_rows(F.col("_v"), F.col("_long"), most, [])))
    fit = F.aggregate(F.zip_with(F.slice("_row", 1, most + 1), F.col("_beta"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    shock = F.coalesce(F.get(F.col("_row"), F.lit(most + 1)) - fit, F.lit(0.0))
    known = on(first, solved(moments(first, s.key, "_row"), most + 2)).withColumn("_shock", shock).drop("_key", "_beta", "_row")
    noisy = recent(seen.of(known), "_shock", top_q + 1, "_noise").rows
    lags = [*(F.get(F.col("_v"), F.lit(j)) for j in ps), *(F.get(F.col("_noise"), F.lit(j)) for j in qs)]
    second = noisy.withColumn("_row", F.when(F.col("_t") >= F.col("_start"), F.array(F.lit(1.0), *lags, F.get(F.col("_v"), F.lit(0)))))
    beta = solved(moments(second, s.key, "_row"), len(ps) + len(qs) + 2)

    last = noisy.groupBy(named(s.key)).agg(F.max_by(F.struct("_seen", "_noise"), s.order).alias("_last"))
    test = split.where(F.col("split") == "test").select(s.key, s.order, F.col("target").alias("actual"))
    test = running(blocks_of(test, s, rows=rows), {"_nth": ("count", s.order)}).rows
    steps = test.groupBy(s.key).agg(F.count("*").alias("steps"))
    whole = on(steps.join(last, F.col(s.key).eqNullSafe(F.col("_key"))).select(s.key, "steps", "_last.*"), beta)

    def forecast(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, n, x, noise, b in f[["_key", "steps", "_seen", "_noise", "_beta"]].itertuples(index=False):
                x = np.asarray(x, float)[::-1]
                v, parts = _differenced(x, d, season)
                with np.errstate(all="ignore"):
                    path = np.concatenate([x[-1:], _undone(_continued(np.asarray(b), ps, qs, v[::-1].tolist(), list(noise), int(n)), parts)])
                    change = path[1:] / path[:-1] - 1
                for lo in range(0, len(change), 1 << 16):
                    part = change[lo : lo + (1 << 16)]
                    yield pd.DataFrame({"_key": [k] * len(part), "_step": np.arange(lo + 1, lo + 1 + len(part)), "predicted": np.where(np.isfinite(part), part, np.nan)})

    paths = whole.select(named("_key"), "steps", "_seen", "_noise", "_beta").mapInPandas(forecast, f"_key {key}, _step long, predicted double")
    out = test.join(paths, F.col(s.key).eqNullSafe(F.col("_key")) & (F.col("_nth") == F.col("_step")), "left")
    error = F.when(F.col("_step").isNull(), F.lit("the series is too short"))
    return out.select(s.key, s.order, F.lit(name).alias("model"), F.lit("TS").alias("type"), F.lit(ord_).alias("ord"), "actual", F.nanvl("predicted", F.lit(None).cast("double")).alias("predicted"), error.alias("fit_error"))
