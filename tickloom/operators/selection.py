"""Order statistics without gathering a key's values: rounds of histograms narrow down where a rank lies, and only that bin is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import ColumnOrName, Series, column
from ..sources.scratch import kept

S = Series()
#: Bins of a round, and values of a bin that are few enough to be sorted in one task.
BINS, GATHER = 1024, 10_000
_TARGET = ("key", "rank")


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """A number from 0 to bins - 1 that never falls as x grows from lo to hi. Halves, as hi - lo can be beyond doubles."""
    share = F.coalesce(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def _values(df: DataFrame, key: str, value: ColumnOrName) -> DataFrame:
    """(row_key, x): doubles that aren't null or NaN, -0 as 0."""
    rows = df.select(F.col(key).alias("row_key"), (column(value).cast("double") + F.lit(0.0)).alias("x"))
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def order_statistics(df: DataFrame, key: str, value: ColumnOrName, ranks: DataFrame, *, bins: int = BINS, gather: int = GATHER) -> DataFrame:
    """(key, rank, value): the value of each of ranks(key, rank), from 0 up, as a double.

    A round counts the values between a rank's bounds in `bins` bins, with each bin's least and greatest value, in one aggregate that combines in each
    task; the bin that holds the rank gives the next bounds. Once it has at most `gather` values, or only equal ones, its
    values are sorted. So no key's values come together, however many they are, and a hot key's rows can be split. Nulls and NaN don't count. Ranks
    beyond a key's values give no row.
    """
    rows = _values(df, key, value)
    span = rows.groupBy("row_key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    todo = ranks.select(F.col(key).alias("key"), F.col("rank").cast("long").alias("rank")).distinct().join(span, F.col("key").eqNullSafe(F.col("row_key")))
    todo = kept(todo.where(F.col("rank").between(0, F.col("n") - 1)).select(*_TARGET, "lo", "hi", F.lit(0).cast("long").alias("below"), "n"), "ranks")
    within = F.col("key").eqNullSafe(F.col("row_key")) & F.col("x").between(F.col("lo"), F.col("hi"))
    wide = (F.col("n") > gather) & (F.col("lo") < F.col("hi"))
    done = todo.where(~wide)
    todo = todo.where(wide)
    while not todo.isEmpty():
        cells = rows.join(todo.select(*_TARGET, "lo", "hi", "below"), within).groupBy(*_TARGET, "below", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        cells = cells.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*_TARGET).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("below", F.col("below") + before).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        todo = kept(cells.select(*_TARGET, "lo", "hi", "below", "n"), "ranks")
        done = done.unionByName(todo.where(~wide))
        todo = todo.where(wide)
    few = rows.join(done.where("lo < hi"), within)
    nth = F.row_number().over(Window.partitionBy(*_TARGET).orderBy("x"))
    sorted_ = few.withColumn("nth", nth).where(F.col("nth") == F.col("rank") - F.col("below") + 1).select(*_TARGET, "x")
    return sorted_.unionByName(done.where("lo = hi").select(*_TARGET, F.col("lo").alias("x"))).select(F.col("key").alias(key), "rank", F.col("x").alias("value"))


def exact_quantile(df: DataFrame, key: str, value: ColumnOrName, q: float, *, gather: int = GATHER) -> DataFrame:
    """(key, n, value): the q-quantile of each key's values by linear interpolation of the two nearest ranks, exactly. Keys without
    values have no row."""
    if not 0 <= q <= 1:
        raise ValueError(f"{q} is no share")
    at = F.lit(q) * (F.col("n") - 1)
    counts = kept(_values(df, key, value).groupBy(F.col("row_key").alias("key")).agg(F.count("*").alias("n")).withColumns({"first": F.floor(at), "part": at - F.floor(at)}), "counts")
    ranks = counts.select(F.col("key").alias(key), F.explode(F.array("first", F.ceil(at))).alias("rank"))
    found = order_statistics(df, key, value, ranks, gather=gather).select(F.col(key).alias("own"), "rank", F.col("value").alias("x"))
    lo, hi = (F.min(F.when(F.col("rank") == F.col("first"), F.col("x"))), F.max(F.when(F.col("rank") == F.col("first") + 1, F.col("x"))))
    both = counts.join(found, F.col("key").eqNullSafe(F.col("own"))).groupBy("key", "n", "part").agg(lo.alias("lo"), hi.alias("hi"))
    value_ = F.when(F.col("part") > 0, F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo"))).otherwise(F.col("lo"))
    return both.select(F.col("key").alias(key), "n", value_.alias("value"))


def tail_risk(frame: DataFrame, returns: str = "daily_return", s: Series = S, *, tail: float = 0.05) -> DataFrame:
    """(key, n_returns, var, cvar) of each series: the `tail` quantile of its returns and the mean of those at most that, both in percent. As risk_profile()
    has them, for series too long to be sorted in one task."""
    r = F.col(returns)
    bound = exact_quantile(frame, s.key, returns, tail).select(F.col(s.key).alias("_key"), "n", F.col("value").alias("_bound"))
    rows = frame.where(r.isNotNull() & ~F.isnan(r)).join(bound, F.col(s.key).eqNullSafe(F.col("_key")))
    return rows.groupBy(s.key).agg(F.first("n").alias("n_returns"), (F.first("_bound") * 100).alias("var"), (F.avg(F.when(r <= F.col("_bound"), r)) * 100).alias("cvar"))
