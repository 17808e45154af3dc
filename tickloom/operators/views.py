"""Result sets behind charts and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series

S = Series()
TAIL_ROWS, YEAR_ROWS = 200, 252


def tail(frame: DataFrame, n: int = TAIL_ROWS, s: Series = S) -> DataFrame:
    """Each series' last n rows, or all if there are fewer."""
    return frame.withColumn("_back", s.number_from_last()).where(F.col("_back") <= n).drop("_back")


def header_metrics(frame: DataFrame, s: Series = S) -> DataFrame:
    """A row for each series: last close, its change in percent, trailing_return (over the last 252 rows, or all),
    volume in millions, RSI and its band, and volume over its mean of 20 rows."""
    rows = frame.withColumns({"_back": s.number_from_last(), "_n": F.count("*").over(s.whole)})
    at = lambda c, k: F.max(F.when(F.col("_back") == k, F.col(c)))
    base = F.when(F.first("_n") > YEAR_ROWS, at("close", YEAR_ROWS)).otherwise(F.max(F.when(F.col("_back") == F.col("_n"), F.col("close"))))
    one = rows.groupBy(s.key).agg(
        F.first("_n").alias("n_rows"), at("close", 1).alias("last_close"), at("close", 2).alias("_before"), base.alias("_base"),
        at("volume", 1).alias("_volume"), at("rsi", 1).alias("last_rsi"), F.avg(F.when(F.col("_back") <= 20, F.col("volume"))).alias("_mean_volume"),
    )
    change = (F.try_divide(F.col("last_close"), F.col("_before")) - 1) * 100
    return one.select(
        s.key, "n_rows", "last_close", change.alias("change_percent"), F.coalesce(change >= 0, F.lit(False)).alias("is_up"),
        ((F.try_divide(F.col("last_close"), F.col("_base")) - 1) * 100).alias("trailing_return"), (F.col("_volume") / 1e6).alias("volume_millions"),
        "last_rsi", F.when(F.col("last_rsi") > 70, "Overbought").when(F.col("last_rsi") < 30, "Oversold").otherwise("Neutral").alias("rsi_band"),
        F.try_divide(F.col("_volume"), F.col("_mean_volume")).alias("volume_ratio"),
    )


def price_panel(frame: DataFrame, n: int = TAIL_ROWS, s: Series = S) -> DataFrame:
    return tail(frame, n, s).select(s.key, s.order, "open", "high", "low", "close", "bb_upper", "bb_lower", "sma_20", "sma_50")


def macd_panel(frame: DataFrame, n: int = TAIL_ROWS, s: Series = S) -> DataFrame:
    return tail(frame, n, s).select(s.key, s.order, "macd", "macd_signal")


def volume_panel(frame: DataFrame, n: int = TAIL_ROWS, s: Series = S) -> DataFrame:
    return tail(frame, n, s).select(s.key, s.order, "volume", (F.col("close") >= F.col("open")).alias("is_up"))


def growth_curve(frame: DataFrame, s: Series = S, base: float = 100.0) -> DataFrame:
    """base compounded by the returns from the first row on."""
    return frame.select(s.key, s.order, (s.compounded("daily_return") * base).alias("growth"))
