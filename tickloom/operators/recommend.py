"""A recommendation for each series, by rules over its risk, its best model's score and its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each rule: (column, comparison, ((bound, points), ...), factor of the highest tier). Fixed values.
TIERS = (
    ("best_r2", ">", ((0.7, 3), (0.4, 1))),
    ("sharpe_ratio", ">", ((1.5, 3), (1.0, 2), (0.5, 1))),
    ("sortino_ratio", ">", ((1.5, 2),)),
    ("annual_volatility", "<", ((20.0, 2), (35.0, 1))),
    ("max_drawdown", ">", ((-15.0, 2), (-25.0, 1))),
)
#: Least score of each label, its class. Fixed values.
LABELS = ((8, "STRONG BUY", "buy"), (5, "BUY", "buy"), (2, "HOLD", "hold"), (-1, "REDUCE", "sell"))
REASONS = 4


def _points(column: str, sign: str, tiers: tuple[tuple[float, int], ...]) -> Column:
    c, out = F.col(column), None
    for bound, points in tiers:
        test = c > bound if sign == ">" else c < bound
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(0)


def score() -> Column:
    total = F.lit(0)
    for rule in TIERS:
        total = total + _points(*rule)
    trend = F.when(F.col("has_strong_trend") & ~F.col("is_high_volatility"), 2).otherwise(0)
    return total + trend + F.when(F.col("is_high_volatility"), -2).otherwise(0)


def factors() -> Column:
    """The reasons that hold, in a fixed order."""
    r2 = F.when(F.col("best_r2") > 0.7, F.concat(F.lit("Strong AI prediction (R²="), F.format_string("%.3f", F.col("best_r2")), F.lit(")"))).when(F.col("best_r2") > 0.4, "Moderate prediction accuracy")
    every = F.array(
        r2,
        F.when(F.col("sharpe_ratio") > 1.5, "Excellent risk-adjusted returns"),
        F.when(F.col("sortino_ratio") > 1.5, "Excellent downside protection"),
        F.when(F.col("annual_volatility") < 20, "Low volatility"),
        F.when(F.col("max_drawdown") > -15, "Strong drawdown control"),
        F.when(F.col("has_strong_trend") & ~F.col("is_high_volatility"), "Strong positive trend"),
        F.when(F.col("is_high_volatility"), "High volatility risk"),
    )
    return F.filter(every, lambda x: x.isNotNull())


def recommend(inputs: DataFrame) -> DataFrame:
    """inputs(symbol..., best_r2, sharpe_ratio, sortino_ratio, annual_volatility, max_drawdown, has_strong_trend,
    is_high_volatility) with score, label, rec_type, factors and reasoning (the first four factors).

    Without a risk figure or a model score: HOLD, "Insufficient data" and a null score. Comparisons are strict.
    """
    # annual_volatility and best_r2 are there whenever risk and performance are
    known = F.col("annual_volatility").isNotNull() & F.col("best_r2").isNotNull()
    flags = inputs.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_strong_trend", "is_high_volatility")})
    scored = flags.withColumns({"score": F.when(known, score()), "factors": F.when(known, factors()).otherwise(F.array().cast("array<string>"))})
    label, kind = F.when(~known, "HOLD"), F.when(~known, "hold")
    for least, name, own in LABELS:
        label, kind = label.when(F.col("score") >= least, name), kind.when(F.col("score") >= least, own)
    reasoning = F.when(known, F.array_join(F.slice("factors", 1, REASONS), " | ")).otherwise("Insufficient data")
    return scored.withColumns({"label": label.otherwise("SELL"), "rec_type": kind.otherwise("sell"), "reasoning": reasoning})


def recommendation_inputs(risk: DataFrame, metrics: DataFrame, profile: DataFrame, key: str = "symbol") -> DataFrame:
    best = metrics.groupBy(key).agg(F.max("r2").alias("best_r2"), F.countDistinct("model").alias("n_models"))
    flags = profile.select(key, "has_strong_trend", "is_high_volatility")
    return flags.join(risk, key, "left").join(best, key, "left")
