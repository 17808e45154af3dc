"""Technical indicators of bars(symbol, dt, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series, complete
from .ewm import ewm_means

S = Series()
#: Columns that indicators() adds, in order.
INDICATORS = [
    "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "rsi", "macd", "macd_signal", "bb_middle", "bb_upper", "bb_lower",
    "volume_sma", "volume_ratio", "daily_return", "cumulative_return", "momentum_10", "momentum_20",
]


def sma(n: int, c: str = "close", s: Series = S) -> Column:
    return s.rolling(F.avg, c, n)


def rsi(mean_gain: Column, mean_loss: Column) -> Column:
    """100 - 100 / (1 + gain / loss); 100 without losses, null without either."""
    return F.when((mean_loss == 0) & (mean_gain > 0), 100.0).otherwise(100 - 100 / (1 + F.try_divide(mean_gain, mean_loss)))


def add_rsi(bars: DataFrame, n: int = 14, out: str = "rsi", s: Series = S) -> DataFrame:
    """Relative strength by simple rolling means. The first row counts as neither gain nor loss."""
    moves = bars.withColumn("_move", s.diff("close"))
    moves = moves.withColumns({"_gain": F.when(F.col("_move") > 0, F.col("_move")).otherwise(0.0), "_loss": F.when(F.col("_move") < 0, -F.col("_move")).otherwise(0.0)})
    means = moves.withColumns({"_gain": s.rolling(F.avg, "_gain", n), "_loss": s.rolling(F.avg, "_loss", n)})
    return means.withColumn(out, rsi(F.col("_gain"), F.col("_loss"))).drop("_move", "_gain", "_loss")


def add_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, s: Series = S) -> DataFrame:
    base = bars.withColumns({"bb_middle": s.rolling(F.avg, "close", n), "_dev": s.rolling(F.stddev_samp, "close", n)})
    return base.withColumns({"bb_upper": F.col("bb_middle") + width * F.col("_dev"), "bb_lower": F.col("bb_middle") - width * F.col("_dev")}).drop("_dev")


def add_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, s: Series = S) -> DataFrame:
    """ema_<fast>, ema_<slow>, their difference macd, and its own exponential mean macd_signal."""
    base = ewm_means(bars, {f"ema_{fast}": ("close", fast), f"ema_{slow}": ("close", slow)}, s)
    return ewm_means(base.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}")), {"macd_signal": ("macd", signal)}, s)


def volume_columns(n: int = 20, s: Series = S) -> dict[str, Column]:
    mean = s.rolling(F.avg, "volume", n)
    return {"volume_sma": mean, "volume_ratio": F.try_divide(F.col("volume"), mean)}


def momentum(k: int, c: str = "close", s: Series = S) -> Column:
    return s.pct_change(c, k)


def return_columns(s: Series = S) -> dict[str, Column]:
    return {"daily_return": s.pct_change("close")}


def indicators(bars: DataFrame, s: Series = S) -> DataFrame:
    """bars with INDICATORS on every row, null where a window isn't full yet."""
    flat = bars.withColumns({
        "sma_20": sma(20, s=s), "sma_50": sma(50, s=s), "sma_200": sma(200, s=s), "momentum_10": momentum(10, s=s), "momentum_20": momentum(20, s=s),
        **volume_columns(s=s), **return_columns(s),
    })
    flat = add_bollinger(add_rsi(flat, s=s), s=s).withColumn("cumulative_return", s.compounded("daily_return"))
    whole = add_macd(flat, s=s)
    return whole.select(*bars.columns, *INDICATORS)


def indicator_frame(bars: DataFrame, s: Series = S) -> DataFrame:
    """indicators() without rows that lack any value: of n bars, n - 199 stay unless other values lack."""
    return complete(indicators(bars, s))
