"""Feature tables for forecasting the next return: lags, rolling statistics, time split, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series, complete

S = Series()
LAGS, WINDOWS, MOMENTA = (1, 2, 3, 5, 10, 20), (5, 10, 20, 50), (5, 10, 20)
MIN_ROWS, TRAIN_SHARE = 100, 0.8
#: The model's inputs, in order.
FEATURES = [
    "volume", "rsi", "macd", "macd_signal", "volume_sma", "volume_ratio", "momentum_10", "momentum_20",
    *(f"price_lag_{k}" for k in LAGS),
    *(f"roll_{stat}_{n}" for n in WINDOWS for stat in ("mean", "std", "min", "max")),
    "momentum_5", *(f"roc_{k}" for k in MOMENTA), "volume_change", "rsi_norm", "macd_diff",
]


def feature_columns(frame: DataFrame, s: Series = S) -> DataFrame:
    """An indicator frame with FEATURES and target, the next row's return; nulls where windows aren't full."""
    made = {f"price_lag_{k}": s.lag("close", k) for k in LAGS}
    for n in WINDOWS:
        made |= {f"roll_{name}_{n}": s.rolling(agg, "close", n) for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}
    made |= {f"momentum_{k}": s.pct_change("close", k) for k in MOMENTA}
    made |= {"volume_change": s.pct_change("volume"), "volume_ratio": F.try_divide(F.col("volume"), s.rolling(F.avg, "volume", 20))}
    made |= {"rsi_norm": F.col("rsi") / 100, "macd_diff": F.col("macd") - F.col("macd_signal"), "target": F.try_divide(s.lead("close"), F.col("close")) - 1}
    out = frame.withColumns(made)
    # a rate of change is the momentum of as many rows
    return out.withColumns({f"roc_{k}": F.col(f"momentum_{k}") for k in MOMENTA})


def feature_frame(frame: DataFrame, s: Series = S, min_rows: int = MIN_ROWS) -> DataFrame:
    """Key, order, close, FEATURES and target of rows that lack nothing; series of fewer than min_rows such rows go."""
    whole = complete(feature_columns(frame, s).select(s.key, s.order, "close", *FEATURES, "target"))
    return whole.withColumn("_n", F.count("*").over(s.whole)).where(F.col("_n") >= min_rows).drop("_n")


def time_split(features: DataFrame, s: Series = S, share: float = TRAIN_SHARE) -> DataFrame:
    """features with split: "train" for the first int(share * n) rows of each series, "test" for the rest."""
    numbered = features.withColumns({"_at": s.number(), "_n": F.count("*").over(s.whole)})
    return numbered.withColumn("split", F.when(F.col("_at") <= F.floor(share * F.col("_n")), "train").otherwise("test")).drop("_at", "_n")


def scaled(split: DataFrame, s: Series = S, columns: list[str] | None = None) -> DataFrame:
    """split with its columns (FEATURES) centred and divided by the population deviation, both of the series'
    train rows; a deviation of 0 divides by 1. No row of the test part has a say."""
    train = F.col("split") == "train"
    stats, out = {}, {}
    for c in columns or FEATURES:
        own = F.when(train, F.col(c))
        stats |= {f"_m_{c}": F.avg(own).over(s.whole), f"_s_{c}": F.stddev_pop(own).over(s.whole)}
        out[c] = (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return split.withColumns(stats).withColumns(out).drop(*stats)


def scaler_parameters(split: DataFrame, s: Series = S, columns: list[str] | None = None) -> DataFrame:
    """(symbol, feature, mean, scale) of the train rows, one row for each feature."""
    names = columns or FEATURES
    aggs = [a for c in names for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    wide = split.where(F.col("split") == "train").groupBy(s.key).agg(*aggs)
    listed = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("scale")) for c in names))).alias("p")
    return wide.select(s.key, listed).select(s.key, "p.*")
