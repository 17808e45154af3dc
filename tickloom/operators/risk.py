"""Risk of daily returns: annual ratios, drawdowns, value at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import RISK_FREE, TRADING_DAYS, annual_volatility, sharpe, sortino
from ..functions.series import Series

S = Series()
MIN_RETURNS, TAIL = 30, 0.05


def drawdowns(frame: DataFrame, returns: str = "daily_return", s: Series = S) -> DataFrame:
    """frame's rows that have a return, with growth (of 1 since the first of them), peak (its greatest so far) and
    drawdown (percent below the peak)."""
    grown = frame.where(F.col(returns).isNotNull()).withColumn("growth", s.compounded(returns))
    peaked = grown.withColumn("peak", s.expanding(F.max, "growth"))
    return peaked.withColumn("drawdown", F.try_divide(F.col("growth") - F.col("peak"), F.col("peak")) * 100)


def risk_profile(frame: DataFrame, returns: str = "daily_return", s: Series = S, *, min_returns: int = MIN_RETURNS, days: int = TRADING_DAYS, risk_free: float = RISK_FREE) -> DataFrame:
    """A row for each series of at least min_returns returns: n_returns, annual_volatility (percent), sharpe_ratio,
    sortino_ratio, max_drawdown, var_95 and cvar_95 (percent).

    The tail's bound, the 5th percentile by linear interpolation, is a window on the same partitioning
    as the drawdowns: one exchange for all.
    """
    r = F.col(returns)
    rows = drawdowns(frame, returns, s).withColumn("_p5", F.percentile(r, TAIL).over(s.whole))
    return rows.groupBy(s.key).agg(
        F.count(r).alias("n_returns"),
        (annual_volatility(r, days) * 100).alias("annual_volatility"),
        sharpe(r, days, risk_free).alias("sharpe_ratio"),
        sortino(r, days, risk_free).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        (F.first("_p5") * 100).alias("var_95"),
        (F.avg(F.when(r <= F.col("_p5"), r)) * 100).alias("cvar_95"),
    ).where(F.col("n_returns") >= min_returns)
