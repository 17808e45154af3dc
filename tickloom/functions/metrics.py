"""Aggregates: risk measures of returns and errors of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252
RISK_FREE = 0.02


def annual_volatility(returns: Column, days: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(returns) * math.sqrt(days)


def _excess_over(returns: Column, deviation: Column, days: int, risk_free: float) -> Column:
    """Annual excess return over an annual deviation; 0 where that isn't positive."""
    return F.when(deviation > 0, (F.avg(returns) * days - risk_free) / (deviation * math.sqrt(days))).otherwise(0.0)


def sharpe(returns: Column, days: int = TRADING_DAYS, risk_free: float = RISK_FREE) -> Column:
    return _excess_over(returns, F.coalesce(F.stddev_samp(returns), F.lit(0.0)), days, risk_free)


def downside_deviation(returns: Column) -> Column:
    """The sample deviation of negative returns; 0 if there are fewer than two."""
    return F.coalesce(F.stddev_samp(F.when(returns < 0, returns)), F.lit(0.0))


def sortino(returns: Column, days: int = TRADING_DAYS, risk_free: float = RISK_FREE) -> Column:
    return _excess_over(returns, downside_deviation(returns), days, risk_free)


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def r2(actual: Column, predicted: Column) -> Column:
    """1 - SSE / SST about the mean of the scored actuals: negative for worse than that mean; null if they're all equal."""
    return 1 - F.try_divide(F.sum(F.pow(actual - predicted, 2)), F.var_pop(actual) * F.count(actual))
