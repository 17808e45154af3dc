"""Profile of a series: volatility, trend, weekly pattern, stationarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import annual_volatility
from ..functions.series import Series
from ..sources.scratch import kept
from .moments import lag_rows, moments, recent, solve
from .segments import ROWS, Blocks, blocks_of

S = Series()
HIGH_VOLATILITY, STRONG_TREND, SEASONAL, SEASONAL_ROWS = 0.4, 0.15, 0.02, 365


def weekday_means(frame: DataFrame, s: Series = S) -> DataFrame:
    """(symbol, weekday, mean_close); Monday is 0."""
    return frame.groupBy(s.key, F.weekday(s.order).alias("weekday")).agg(F.avg("close").alias("mean_close"))


def seasonality(frame: DataFrame, s: Series = S) -> DataFrame:
    """(symbol, weekly_variation): the deviation of the weekdays' mean closes over the mean close of all rows."""
    day = frame.groupBy(s.key, F.weekday(s.order).alias("weekday")).agg(F.avg("close").alias("m"), F.sum("close").alias("t"), F.count("close").alias("n"))
    return day.groupBy(s.key).agg(F.try_divide(F.stddev_samp("m"), F.try_divide(F.sum("t"), F.sum("n"))).alias("weekly_variation"), F.sum("n").alias("n_rows"))


def trend(frame: DataFrame, s: Series = S) -> DataFrame:
    """(symbol, signed_trend, trend_strength): the mean of the last 60 closes over that of the 60 that end 200 rows
    earlier, less 1, and its size; null if there are no such rows."""
    rows = frame.withColumn("_back", s.number_from_last()).where(F.col("_back") <= 260)
    late, early = F.avg(F.when(F.col("_back") <= 60, F.col("close"))), F.avg(F.when(F.col("_back") > 200, F.col("close")))
    return rows.groupBy(s.key).agg((F.try_divide(late, early) - 1).alias("signed_trend")).withColumn("trend_strength", F.abs("signed_trend"))


def series_profile(frame: DataFrame, s: Series = S) -> DataFrame:
    """A row for each series: volatility (annual, as a fraction), is_high_volatility, signed_trend, trend_strength,
    has_strong_trend (either way), weekly_variation and has_seasonality (of at least 365 rows).

    One aggregate of the frame, on the partitioning that its windows have: what trend and seasonality say of it."""
    back, close, day = F.col("_back"), F.col("close"), F.weekday(s.order)
    rows = frame.withColumn("_back", s.number_from_last())
    one = rows.groupBy(s.key).agg(
        annual_volatility(F.col("daily_return")).alias("volatility"),
        (F.try_divide(F.avg(F.when(back <= 60, close)), F.avg(F.when(back.between(201, 260), close))) - 1).alias("signed_trend"),
        F.filter(F.array(*(F.avg(F.when(day == k, close)) for k in range(7))), lambda m: m.isNotNull()).alias("_days"),
        F.avg(close).alias("_mean"),
        F.count(close).alias("_n"),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    middle = F.try_divide(total(F.col("_days")), F.size("_days"))
    spread = F.sqrt(F.try_divide(total(F.transform("_days", lambda m: F.pow(m - F.col("_middle"), 2))), F.size("_days") - 1))
    wide = one.withColumn("_middle", middle).withColumns({"trend_strength": F.abs("signed_trend"), "weekly_variation": F.try_divide(spread, F.col("_mean"))})
    true = lambda c: F.coalesce(c, F.lit(False))
    return wide.select(
        s.key, "volatility", true(F.col("volatility") > HIGH_VOLATILITY).alias("is_high_volatility"), "signed_trend", "trend_strength", true(F.col("trend_strength") > STRONG_TREND).alias("has_strong_trend"),
        "weekly_variation", true((F.col("_n") >= SEASONAL_ROWS) & (F.col("weekly_variation") > SEASONAL)).alias("has_seasonality"),
    )


#: Asymptotic 5 % critical value of the test with a constant, and its terms in 1 / n (MacKinnon 2010). Fixed values.
ADF_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)


def _lag_order(gram: np.ndarray, n: int, most: int) -> int:
    """The number of lags of the least AIC, all orders on the same rows: each is a part of one table of moments."""
    def aic(p: int) -> float:
        part = np.r_[: 2 + p, -1]
        _, sse, _ = solve(gram[np.ix_(part, part)], 2 + p, 2 + p)
        return n * math.log(max(sse, 1e-300) / n) + 2 * (2 + p)

    return min(range(most + 1), key=aic)


def _statistic(gram: np.ndarray, n: int, p: int) -> float:
    """The t statistic of the level."""
    part = np.r_[: 2 + p, -1]
    beta, sse, inverse = solve(gram[np.ix_(part, part)], 2 + p, 2 + p)
    cov = inverse[1, 1] * sse / max(1, n - 2 - p)
    return float(beta[1] / math.sqrt(cov)) if cov > 0 else 0.0


def dickey_fuller_rows(b: Blocks, c: str, most: int) -> Blocks:
    """b with the array _seen of the last values of c and their number _seen_at, from which dickey_fuller_row() makes a regression's row."""
    return recent(b, c, most + 2, "_seen")


def dickey_fuller_row(lags: Column, most: int) -> Column:
    """[1, the value before, the last changes before (those after `lags` as 0), the change]."""
    change = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: F.get(F.col("_seen"), j) - F.get(F.col("_seen"), j + 1))
    return lag_rows(change, lags, most, [F.get(F.col("_seen"), F.lit(1))])


def stationarity(frame: DataFrame, s: Series = S, c: str = "close", min_rows: int = 20, rows: int = ROWS) -> DataFrame:
    """(symbol, n_rows, adf_statistic, critical_5, n_lags, is_stationary): the augmented Dickey-Fuller test with a constant, its lags by AIC
    on common rows; a unit root is rejected at 5 %.

    Two passes of moments over the series' blocks: one for the order, of as many lags as the series' length allows, and one
    for the statistic of that order on all its rows. A series is one row of moments when anything is solved, however long it is. Fewer than min_rows
    values, or a constant series: a null statistic and false.
    """
    x = F.col("_x")
    values = frame.select(s.key, s.order, F.col(c).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    size = values.groupBy(s.key).agg(F.count("*").alias("n_rows"), F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_dev"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    most = F.least(F.ceil(12 * F.pow(F.col("n_rows") / 100, 0.25)), F.floor(F.col("n_rows") / 2) - 2).cast("int")
    size = kept(size.withColumn("_most", F.when((F.col("n_rows") >= min_rows) & (F.col("_lo") < F.col("_hi")) & (F.col("_dev") > 0), most)), "sizes")
    able = size.where(F.col("_most").isNotNull()).select(F.col(s.key).alias("_key"), "_mean", "_dev", "_most")
    top = able.agg(F.max("_most")).first()[0]
    kind = frame.schema[s.key].dataType.simpleString()
    if top is None:
        none = lambda t, n: F.lit(None).cast(t).alias(n)
        return size.select(s.key, "n_rows", none("double", "adf_statistic"), none("double", "critical_5"), none("long", "n_lags"), F.lit(False).alias("is_stationary"))

    def solved(grams: DataFrame, by: str, work, out: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                made = [work(np.asarray(g).reshape(top + 3, top + 3), int(n), int(k)) for g, n, k in zip(f["moments"], f["n"], f[by], strict=True)]
                yield pd.DataFrame({"key": f["key"], "lags": f[by], "out": made})

        return grams.select(F.col(s.key).alias("key"), "n", "moments", by).mapInPandas(run, f"key {kind}, lags long, out {out}")

    # centred and scaled, which the statistic doesn't feel, so that the moments keep their digits
    scaled = values.join(able, F.col(s.key).eqNullSafe(F.col("_key"))).select(s.key, s.order, ((x - F.col("_mean")) / F.col("_dev")).alias("_x"), "_most")
    seen = dickey_fuller_rows(blocks_of(scaled, s, rows=rows, reach=top + 1), "_x", top).rows
    first = seen.where(F.col("_seen_at") >= F.col("_most") + 2).withColumn("_row", dickey_fuller_row(F.col("_most"), top))
    one = lambda grams, of: grams.join(of.withColumnRenamed(s.key, "_of") if s.key in of.columns else of, F.col(s.key).eqNullSafe(F.col("_of")))
    order = solved(one(moments(first, s.key, "_row"), able.select(F.col("_key").alias("_of"), "_most")), "_most", _lag_order, "long")
    order = kept(order.select(F.col("key").alias("_of"), F.col("out").alias("_lags")), "orders")
    second = one(seen, order).where(F.col("_seen_at") >= F.col("_lags") + 2).withColumn("_row", dickey_fuller_row(F.col("_lags"), top))
    tested = solved(one(moments(second, s.key, "_row"), order), "_lags", _statistic, "double")
    a, b, c2, d = ADF_5_PERCENT
    m = F.col("n_rows")
    out = size.select(s.key, "n_rows").join(tested, F.col(s.key).eqNullSafe(F.col("key")), "left").withColumn("critical_5", F.when(F.col("out").isNotNull(), a + b / m + c2 / m**2 + d / m**3))
    return out.select(s.key, "n_rows", F.col("out").alias("adf_statistic"), "critical_5", F.col("lags").alias("n_lags"), F.coalesce(F.col("out") < F.col("critical_5"), F.lit(False)).alias("is_stationary"))


def characteristics(frame: DataFrame, s: Series = S) -> DataFrame:
    """A row for each series: is_stationary of its closes, is_high_volatility, has_strong_trend, has_seasonality,
    volatility and trend_strength: all the badges of a series together."""
    tested = stationarity(frame, s).select(s.key, "is_stationary")
    return series_profile(frame, s).join(tested, s.key).select(s.key, "is_stationary", "is_high_volatility", "has_strong_trend", "has_seasonality", "volatility", "trend_strength")
