"""Scans of long series in blocks: the blocks of one series are worked on in different tasks, and what earlier blocks add is carried into each."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import Series
from ..sources.scratch import kept
from .ewm import TINY, ewm_sums

S = Series()
#: Rows of a block, about, and the most blocks of a series: longer series have longer blocks.
ROWS, MOST_BLOCKS = 1 << 18, 4096
#: Bounds are looked through in two steps of fewer than so many.
_STEP = 64
BLOCK = "_block"


@dataclass(frozen=True)
class Blocks:
    """A frame with a column BLOCK, a number that grows with the order within each series; sizes: (key, BLOCK, n). Scans give
    Blocks again, so that one can follow another; rows is the frame without BLOCK."""

    frame: DataFrame
    sizes: DataFrame
    series: Series

    @property
    def rows(self) -> DataFrame:
        return self.frame.drop(BLOCK)

    def of(self, frame: DataFrame) -> Blocks:
        """Other rows or columns in the same blocks."""
        return replace(self, frame=frame)

    @property
    def forward(self) -> Window:
        return Window.partitionBy(self.series.key, BLOCK).orderBy(self.series.order)

    @property
    def earlier(self) -> Window:
        """Of a table of blocks: all blocks before this one."""
        return Window.partitionBy(self.series.key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def position(c: Column, kind: str) -> Column:
    """A number that orders as a column of the type does."""
    if kind == "timestamp_ntz":
        # from its parts, as a cast to a timestamp would depend on the session's time zone
        second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second
    if kind == "timestamp":
        return F.unix_micros(c)
    return F.unix_date(c).cast("long") if kind == "date" else c


def blocks_of(df: DataFrame, s: Series = S, *, rows: int = ROWS, reach: int = 0) -> Blocks:
    """df cut into blocks of about `rows` rows, at quantiles of each series' order, and of at least `reach` rows each.

    The order is a time, a date or a number, unique in its series. Quantiles are one aggregate that combines in each task; of the series only those longer than
    a block have bounds, so there are fewer bounds than rows / `rows`. Where some block would be shorter than `reach`,
    there are half as many blocks, down to one for each series. A null order comes first, in the first block.
    """
    at = position(F.col(s.order), dict(df.dtypes)[s.order])
    longest = df.groupBy(s.key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most = min(MOST_BLOCKS, -(-longest // rows))
    while most > 1:
        found = df.groupBy(s.key).agg(F.count("*").alias("_n"), F.percentile_approx(at, [k / most for k in range(1, most)], 40 * most).alias("_cuts"))
        own = F.least(F.ceil(F.col("_n") / rows), F.lit(most)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), F.col("_own") - 1), lambda k: F.get(F.col("_cuts"), F.floor(k * most / F.col("_own")).cast("int") - 1))
        bounds = found.withColumn("_own", own).where(F.col("_own") > 1).select(F.col(s.key).alias("_bound_key"), F.array_sort(F.array_distinct(picked)).alias("_cuts"))
        frame = _placed(df.withColumn("_at", at), kept(bounds, "bounds"), s).drop("_at")
        sizes = frame.groupBy(s.key, BLOCK).agg(F.count("*").alias("n"))
        if not reach or (sizes.withColumn("_k", F.count("*").over(Window.partitionBy(s.key))).where("_k > 1").agg(F.min("n")).first()[0] or reach) >= reach:
            return Blocks(frame, sizes, s)
        most //= 2
    frame = df.withColumn(BLOCK, F.lit(0))
    return Blocks(frame, frame.groupBy(s.key, BLOCK).agg(F.count("*").alias("n")), s)


def _placed(df: DataFrame, bounds: DataFrame, s: Series) -> DataFrame:
    """df with BLOCK, the number of its series' bounds(_bound_key, _cuts) that are at most _at; 0 where either is missing.

    Every 64th bound is looked through first, then those up to the next of them, both by halving: rows carry 64 bounds at most, and a lookup is 12
    comparisons. One expression each, as columns of steps would be multiplied out where a filter on BLOCK is pushed below them.
    """
    cuts = bounds.withColumnsRenamed({"_bound_key": "_far_key"})
    every = cuts.select("_far_key", F.filter("_cuts", lambda _, k: (k + 1) % _STEP == 0).alias("_some"))
    parts = bounds.select("_bound_key", "_cuts", F.explode(F.sequence(F.lit(0), F.floor(F.size("_cuts") / _STEP).cast("int"))).alias("_part"))
    parts = parts.select("_bound_key", "_part", F.slice("_cuts", F.col("_part") * _STEP + 1, F.lit(_STEP)).alias("_few"))
    halves = F.array(*(F.lit(_STEP >> k) for k in range(1, _STEP.bit_length())))
    passed = lambda some: F.aggregate(halves, F.lit(0), lambda n, k: n + F.when(F.get(some, n + k - 1) <= F.col("_at"), k).otherwise(0))
    far = df.join(every, F.col(s.key).eqNullSafe(F.col("_far_key")), "left").withColumn("_far", passed(F.col("_some"))).drop("_some", "_far_key")
    near = far.join(parts, F.col(s.key).eqNullSafe(F.col("_bound_key")) & (F.col("_far") == F.col("_part")), "left")
    return near.withColumn(BLOCK, F.col("_far") * _STEP + passed(F.col("_few"))).drop("_far", "_few", "_part", "_bound_key")


def _carried(rows: DataFrame, table: DataFrame, s: Series, names: list[str]) -> DataFrame:
    """rows with the columns `names` of the table of blocks."""
    few = table.select(F.col(s.key).alias("_few_key"), F.col(BLOCK).alias("_few_block"), *names)
    return rows.join(few, F.col(s.key).eqNullSafe(F.col("_few_key")) & (F.col(BLOCK) == F.col("_few_block")), "left").drop("_few_key", "_few_block")


#: Running aggregates by name: of values, and of a block's result and what earlier blocks carry into it.
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _both(merge: Callable[[Column, Column], Column], local: Column, carry: Column) -> Column:
    return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(merge(local, carry))


def _exact_sum(c: Column, s: Series, before: Window) -> Column:
    """The sum of doubles over the window `before` of a series, rounded about once however many there are: multiples of a unit, which add up exactly, and what is left of
    each value, apart."""
    whole = Window.partitionBy(s.key)
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(F.max(F.abs(c)).over(whole) * F.count("*").over(whole))) - 52)
    sure = (unit > 1e-290) & (unit < 1e290)
    high = F.when(sure, F.rint(F.try_divide(c, unit)) * unit).otherwise(c)
    return F.sum(high).over(before) + F.sum(F.when(sure, c - high).otherwise(0.0)).over(before)


def running(b: Blocks, made: dict[str, tuple[str, str]]) -> Blocks:
    """The blocks' rows with a column for each name -> (aggregate, column): the aggregate (RUNNING, or "last" value that isn't null) of all
    values up to the row and of rows at the very same order, as SQL has it. Blocks are reduced to a row each before anything is carried, so a series' tasks are as many as
    its blocks; sums of doubles are carried without the rounding errors of earlier blocks."""
    s, local, summary, carry, kinds = b.series, {}, [], {}, dict(b.frame.dtypes)
    for name, (kind, c) in made.items():
        x = F.col(c)
        if kind == "last":
            local[name] = F.last(x, ignorenulls=True).over(b.forward)
            summary.append(F.max_by(x, F.when(x.isNotNull(), F.col(s.order))).alias(f"_s_{name}"))
            carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(b.earlier)
        else:
            agg, _ = RUNNING[kind]
            local[name] = agg(x).over(b.forward)
            summary.append(agg(x).alias(f"_s_{name}"))
            if kind == "sum" and kinds[c] in ("double", "float"):
                carry[f"_c_{name}"] = _exact_sum(F.col(f"_s_{name}"), s, b.earlier)
            else:
                carry[f"_c_{name}"] = (F.sum if kind == "count" else agg)(F.col(f"_s_{name}")).over(b.earlier)
    table = b.frame.groupBy(s.key, BLOCK).agg(*summary).withColumns(carry)
    rows = _carried(b.frame.withColumns(local), table, s, list(carry))
    whole = {name: _both(RUNNING[kind][1] if kind != "last" else lambda a, c: a, F.col(name), F.col(f"_c_{name}")) for name, (kind, _) in made.items()}
    return b.of(rows.withColumns(whole).drop(*carry))


def rolling(b: Blocks, made: dict[str, tuple]) -> Blocks:
    """The blocks' rows with a column for each name -> (aggregate, column, n): of the last n values, null until there are n that aren't null, as
    Series.rolling has it, or until there are as many as a fourth item says. The last rows of each block go along into the next as its halo; blocks_of(reach=n - 1)
    sees to it that one block's rows are enough."""
    s, reach = b.series, max(n for _, _, n, *_ in made.values()) - 1
    backward = Window.partitionBy(s.key, BLOCK).orderBy(F.col(s.order).desc())
    own = b.frame.withColumn("_halo", F.lit(False))
    if reach:
        # the limit is applied in each task before the shuffle
        halo = b.frame.withColumn("_back", F.row_number().over(backward)).where(F.col("_back") <= reach).drop("_back")
        own = own.unionByName(halo.withColumns({BLOCK: F.col(BLOCK) + 1, "_halo": F.lit(True)}))
    out = {}
    for name, (agg, c, n, *least) in made.items():
        frame = b.forward.rowsBetween(1 - n, 0)
        out[name] = F.when(F.count(F.col(c)).over(frame) >= (least or [n])[0], agg(F.col(c)).over(frame))
    return b.of(own.withColumns(out).where(~F.col("_halo")).drop("_halo"))


def _decay(q: float) -> Callable[[Column, Column], Column]:
    return lambda t, x: t * F.pow(F.lit(q), x["n"]) + x["x"]


def ewm(b: Blocks, means: dict[str, tuple[str, float]]) -> Blocks:
    """The blocks' rows with exponential means as ewm_means() has them. What a block adds to later ones is its last pair of
    decayed sums; as many earlier blocks are added up as weigh anything in doubles."""
    s = b.series
    own = b.frame.withColumn("_series", F.struct(F.col(s.key).alias("k"), F.col(BLOCK).alias("b")))
    sums = ewm_sums(own, means, Series("_series", s.order)).withColumn("_nth", F.row_number().over(b.forward))
    names = [f"_ewm_{kind}_{name}" for name in means for kind in "nd"]
    table = sums.groupBy(s.key, BLOCK).agg(F.count("*").alias("_n"), *(F.max_by(c, "_nth").alias(c) for c in names))
    least = b.sizes.agg(F.min("n")).first()[0] or 1
    carry = {}
    for name, (_, span) in means.items():
        q = 1 - 2 / (span + 1)
        back = max(1, math.ceil(math.log(TINY) / math.log(q) / least)) if q > 0 else 1
        window = Window.partitionBy(s.key).orderBy(BLOCK).rowsBetween(-back, -1)
        for kind in "nd":
            past = F.collect_list(F.struct(F.col("_n").alias("n"), F.col(f"_ewm_{kind}_{name}").alias("x"))).over(window)
            carry[f"_c_{kind}_{name}"] = F.aggregate(past, F.lit(0.0), _decay(q))
    rows = _carried(sums, table.withColumns(carry), s, list(carry))
    decay = lambda name: F.pow(F.lit(1 - 2 / (means[name][1] + 1)), F.col("_nth"))
    whole = {name: F.try_divide(*(F.col(f"_ewm_{kind}_{name}") + decay(name) * F.col(f"_c_{kind}_{name}") for kind in "nd")) for name in means}
    return b.of(rows.withColumns(whole).drop(*names, *carry, "_nth", "_series"))


def drawdown(b: Blocks, returns: str) -> Blocks:
    """The blocks' rows that have a return, with growth, peak and drawdown as risk.drawdowns() has them. A block is reduced to its product and
    the extremes of its own growth: times what is carried in, one of them is its highest point."""
    s = b.series
    kept = b.frame.where(F.col(returns).isNotNull())
    so_far = b.forward
    local = kept.withColumn("_own", F.product(1 + F.col(returns)).over(so_far))
    table = local.groupBy(s.key, BLOCK).agg(F.max_by("_own", s.order).alias("_p"), F.max("_own").alias("_hi"), F.min("_own").alias("_lo"))
    table = table.withColumn("_growth", F.coalesce(F.product("_p").over(b.earlier), F.lit(1.0)))
    table = table.withColumn("_peak", F.max(F.col("_growth") * F.when(F.col("_growth") >= 0, F.col("_hi")).otherwise(F.col("_lo"))).over(b.earlier))
    rows = _carried(local, table, s, ["_growth", "_peak"]).withColumn("growth", F.col("_own") * F.col("_growth"))
    rows = rows.withColumn("peak", F.greatest(F.max("growth").over(so_far), F.col("_peak")))
    return b.of(rows.withColumn("drawdown", F.try_divide(F.col("growth") - F.col("peak"), F.col("peak")) * 100).drop("_own", "_growth", "_peak"))
