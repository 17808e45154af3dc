"""Joins by time: the last row before another, and intervals that overlap; neither makes pairs to throw away, nor puts a series into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from .segments import ROWS, blocks_of, position, running


def asof_join(left: DataFrame, right: DataFrame, key: str = "symbol", order: str = "dt", *, strict: bool = False, rows: int = ROWS) -> DataFrame:
    """left with the columns of the last row of right that has its key and an order at most its own (with strict, below it); nulls where
    there is none. right's columns other than the key and the order are added, its order as <order>_found; (key, order) is unique in right.

    The times asked for, each once, and the rows of right make one series for each key, cut into blocks; the last row of a block is carried
    over the blocks after it until there is another. So a hot key is as many tasks as it has blocks, and left's own columns and repeated
    times don't go through the scan: they are joined by key and time. Rows of a null key or order find nothing.
    """
    kind = dict(left.dtypes)[order]
    carried = [c for c in right.columns if c not in (key, order)]
    clash = {*carried, f"{order}_found"} & set(left.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    own, right = F.col(key).isNotNull() & F.col(order).isNotNull(), right.withColumn(order, F.col(order).cast(kind))
    at = lambda k: (position(F.col(order), kind) * 2 + k).alias("_when")
    asked = left.where(own).select(key, order).distinct().select(key, order, at(0 if strict else 1))
    given = right.where(own).select(key, at(1 if strict else 0), F.struct(F.col(order).alias(f"{order}_found"), *carried).alias("_row"))
    both = asked.unionByName(given, allowMissingColumns=True)
    found = running(blocks_of(both, Series(key, "_when"), rows=rows), {"_last": ("last", "_row")}).rows
    found = found.where(F.col("_row").isNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), "_last")
    joined = left.join(found, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_order")), "left")
    return joined.select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in (f"{order}_found", *carried)))


def bin_width(*sides: DataFrame) -> float:
    """Twice the mean length of the sides' intervals(lo, hi): cut by it, rows grow to less than three times their number, whatever the
    lengths are."""
    total = [side.agg(F.sum(F.col("hi") - F.col("lo")).alias("t"), F.count("*").alias("n")).first() for side in sides]
    n = sum(x["n"] for x in total)
    return max(1.0, 2 * sum(float(x["t"] or 0) for x in total) / n) if n else 1.0


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: float | None = None) -> DataFrame:
    """Pairs of rows of left and right of equal keys whose intervals [lo, hi) overlap: left's columns, then right's other ones.

    Ends are numbers, times or dates of one kind. Intervals are cut into bins of `width` (bin_width()), and rows meet by an equi-join on keys and
    bin, which adaptive execution can split where a bin is hot. A pair that shares several bins counts in the first of them only.
    Empty intervals, and null keys or ends, overlap nothing.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")

    def valued(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        lo, hi = (position(F.col(c), dict(df.dtypes)[c]) for c in ends)
        return df.withColumns({"lo": lo, "hi": hi}).where(F.col("lo") < F.col("hi"))

    clash = {"lo", "hi"} & {*left.columns, *right.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed here")
    a, b = valued(left, left_ends), valued(right, right_ends)
    width = width or bin_width(a, b)

    def binned(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
        last = F.when(last * width >= F.col("hi"), F.greatest(last - 1, first)).otherwise(last)
        cut = df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence("_first", last)))
        return cut.withColumnsRenamed({c: f"_{side}_{c}" for c in ("lo", "hi", "_first", *keys, "_bin")})

    left_bins, right_bins = binned(a, "a"), binned(b, "b")
    meet = F.col("_a__bin") == F.col("_b__bin")
    for k in keys:
        meet &= F.col(f"_a_{k}") == F.col(f"_b_{k}")
    overlap = (F.col("_a_lo") < F.col("_b_hi")) & (F.col("_b_lo") < F.col("_a_hi"))
    pairs = left_bins.join(right_bins, meet & overlap & (F.col("_a__bin") == F.greatest("_a__first", "_b__first")))
    return pairs.select(*(F.col(f"_a_{c}").alias(c) if c in keys else F.col(c) for c in left.columns), *(c for c in right.columns if c not in keys))
