"""Scoring of predictions(symbol, dt, model, type, actual, predicted): metrics, ranking, champion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import mae, r2, rmse
from ..functions.series import Series

S = Series()
PREVIEW_ROWS, TOP = 50, 10
#: Codes of model families and their names. Fixed values.
FAMILIES = {"ML": "Machine Learning", "DL": "Deep Learning", "TS": "Time Series"}


def baseline_predictions(split: DataFrame, s: Series = S) -> DataFrame:
    """Predictions of four closed-form models on the test rows of split features, as a long table: nothing moves
    (zero), the train rows' mean target (train_mean), the row's own return (persistence) and least squares
    of the target on momentum_5 (one_feature). ord is the order in which models are listed.

    Fits are windows over the series, on the partitioning that the features already have.
    """
    own = lambda c: F.when(F.col("split") == "train", F.col(c))
    w = s.whole
    fitted = split.withColumns({
        "_mean": F.avg(own("target")).over(w),
        "_slope": F.regr_slope(own("target"), own("momentum_5")).over(w),
        "_icept": F.regr_intercept(own("target"), own("momentum_5")).over(w),
        "_last": F.try_divide(F.col("close"), F.col("price_lag_1")) - 1,
    }).where(F.col("split") == "test")
    models = {"zero": F.lit(0.0), "train_mean": F.col("_mean"), "persistence": F.col("_last"), "one_feature": F.col("_icept") + F.col("_slope") * F.col("momentum_5")}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit("ML").alias("type"), F.lit(k).alias("ord"), c.alias("predicted")) for k, (m, c) in enumerate(models.items()))))
    return fitted.select(s.key, s.order, F.col("target").alias("actual"), rows.alias("p")).select(s.key, s.order, "p.model", "p.type", "p.ord", "actual", "p.predicted")


def pair_predictions(predictions: DataFrame, actuals: DataFrame, s: Series = S, target: str = "target") -> DataFrame:
    """predictions(symbol, dt, ...) with actual, taken from actuals(symbol, dt, target) by key and not by place."""
    return predictions.join(actuals.select(s.key, s.order, F.col(target).alias("actual")), [s.key, s.order])


def model_metrics(predictions: DataFrame, s: Series = S) -> DataFrame:
    """(symbol, model, type, ord, n, mae, rmse, r2): one row for each series and model."""
    a, p = F.col("actual"), F.col("predicted")
    return predictions.groupBy(s.key, "model", "type", "ord").agg(F.count("*").alias("n"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), r2(a, p).alias("r2"))


def tier(score: Column) -> Column:
    return F.when(score > 0.7, "Excellent").when(score > 0.4, "Good").otherwise("Fair")


def _ranked(metrics: DataFrame, s: Series) -> DataFrame:
    order = Window.partitionBy(s.key).orderBy(F.col("r2").desc_nulls_last(), "ord")
    return metrics.withColumn("rank", F.row_number().over(order))


def merged(*predictions: DataFrame) -> DataFrame:
    """The predictions of several models as one table; rows without a prediction go."""
    names = ["model", "type", "ord", "actual", "predicted"]
    own = [c for c in predictions[0].columns if c not in names and c != "fit_error"]
    return reduce(DataFrame.unionByName, (p.select(*own, *names) for p in predictions)).where(F.col("predicted").isNotNull())


def leaderboard(metrics: DataFrame, s: Series = S, top: int = TOP, without: tuple[str, ...] = ()) -> DataFrame:
    """The best models of each series by r2 (ties: the one listed first), with rank, family and tier; `without` names
    families to leave out, such as ("TS",)."""
    metrics = metrics.where(~F.col("type").isin(*without)) if without else metrics
    family = F.element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), F.col("type"))
    ranked = _ranked(metrics, s).where(F.col("rank") <= top)
    return ranked.select(s.key, "rank", "model", "type", family.alias("family"), "r2", "rmse", "mae", tier(F.col("r2")).alias("tier"))


def champion(metrics: DataFrame, s: Series = S) -> DataFrame:
    return _ranked(metrics, s).where(F.col("rank") == 1).select(s.key, "model", "type", "r2", "rmse", "mae")


def champion_series(predictions: DataFrame, champions: DataFrame, s: Series = S) -> DataFrame:
    """The champion's predictions row by row, with their absolute error."""
    best = champions.select(s.key, "model")
    return predictions.join(best, [s.key, "model"]).select(s.key, s.order, "model", "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("abs_error"))


def best_predictions(predictions: DataFrame, s: Series = S) -> DataFrame:
    """champion_series of the predictions' own champions. Scores are windows over the series, on the partitioning that the
    predictions already have, so that they are made once and not joined with themselves."""
    w = Window.partitionBy(s.key, "model", "type", "ord")
    error = F.col("actual") - F.col("predicted")
    scored = predictions.withColumns({"_sse": F.sum(F.pow(error, 2)).over(w), "_sst": F.var_pop("actual").over(w) * F.count("actual").over(w)})
    rank = F.struct(1 - F.try_divide(F.col("_sse"), F.col("_sst")), -F.col("ord"))
    best = scored.withColumn("_best", F.max_by("model", rank).over(s.whole)).where(F.col("model") == F.col("_best"))
    return best.select(s.key, s.order, "model", "actual", "predicted", F.abs(error).alias("abs_error"))


def preview(predictions: DataFrame, s: Series = S, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of each series' first-listed model."""
    at = F.row_number().over(Window.partitionBy(s.key).orderBy("ord", s.order))
    return predictions.withColumn("_at", at).withColumn("_first", F.first("ord").over(Window.partitionBy(s.key).orderBy("ord", s.order))).where((F.col("_at") <= rows) & (F.col("ord") == F.col("_first"))).drop("_at", "_first")


def preview_metrics(predictions: DataFrame, s: Series = S, rows: int = PREVIEW_ROWS) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    return preview(predictions, s, rows).groupBy(s.key, "model").agg(F.count("*").alias("n"), mae(a, p).alias("mae"), r2(a, p).alias("r2"))


def training_summary(models: DataFrame) -> DataFrame:
    """(type, n_models) of models(model, type, ...), and their total under the type "ALL"."""
    each = models.select("model", "type").distinct()
    return each.rollup("type").agg(F.count("*").alias("n_models")).select(F.coalesce("type", F.lit("ALL")).alias("type"), "n_models")
