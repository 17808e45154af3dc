"""Exponentially weighted means as windows over blocks of rows: linear in the series' length, and never overflowing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import Series

#: Rows of a block, at most. Within a block weights are scaled up to SCALE; blocks that weigh less than TINY are left out.
BLOCK, SCALE, TINY = 512, 1e100, 1e-17
_P = "_ewm_"


def ewm_means(df: DataFrame, means: dict[str, tuple[str, float]], series: Series = Series()) -> DataFrame:
    """df with a column for each name -> (column, span): the mean of all values so far, with weights that fall by
    1 - 2 / (span + 1) a row and are normalised by their sum.

    The first row's mean is its value. A null has no weight, but rows count on; until the first value the mean is null.
    One exchange on the key serves all means.
    """
    out = ewm_sums(df, means, series)
    result = {name: F.try_divide(F.col(f"{_P}n_{name}"), F.col(f"{_P}d_{name}")) for name in means}
    return out.withColumns(result).drop(*(f"{_P}{kind}_{name}" for name in means for kind in "nd")) if means else out


def ewm_sums(df: DataFrame, means: dict[str, tuple[str, float]], series: Series = Series()) -> DataFrame:
    """df with the numerators _ewm_n_<name> and denominators _ewm_d_<name> of ewm_means().

    Rows are cut into blocks of equal numbers. In a block, weighted sums are prefix sums of scaled values; what
    earlier blocks add is their last sums, decayed, of as many blocks as weigh anything in doubles.
    """
    if not means:
        return df
    p = _P
    decays = {name: 1 - 2 / (span + 1) for name, (_, span) in means.items()}
    steepest = min((q for q in decays.values() if q > 0), default=0.0)
    size = max(1, min(BLOCK, int(math.log(SCALE) / -math.log(steepest)) if steepest > 0 else 1))
    at, block, within = f"{p}at", f"{p}block", f"{p}within"
    out = df.withColumn(at, series.number() - 1)
    out = out.withColumns({block: F.floor(F.col(at) / size).cast("long"), within: (F.col(at) % size).cast("double")})
    own = Window.partitionBy(series.key, block).orderBy(series.order).rowsBetween(Window.unboundedPreceding, 0)

    def local(value: Column, q: float) -> Column:
        return F.pow(F.lit(q), F.col(within)) * F.sum(value * F.pow(F.lit(1 / q), F.col(within))).over(own)

    sums = {}
    for name, (c, _) in means.items():
        x, q = F.col(c).cast("double"), decays[name]
        if q <= 0:
            continue
        sums[f"{p}n_{name}"] = local(F.coalesce(x, F.lit(0.0)), q)
        sums[f"{p}d_{name}"] = local(F.when(x.isNull(), 0.0).otherwise(1.0), q)
    out = out.withColumns(sums)
    carried = {}
    for name, q in decays.items():
        if q <= 0:
            continue
        back = max(1, math.ceil(math.log(TINY) / math.log(q ** size))) if q ** size > 0 else 1
        for kind in "nd":
            c = f"{p}{kind}_{name}"
            total = None
            for j in range(1, back + 1):
                frame = Window.partitionBy(series.key).orderBy(block).rangeBetween(-j, -j)
                last = F.coalesce(F.max_by(c, at).over(frame), F.lit(0.0)) * q ** (size * (j - 1))
                total = last if total is None else total + last
            carried[f"{p}c{kind}_{name}"] = total
    out = out.withColumns(carried)
    whole = {}
    for name, (c, _) in means.items():
        q = decays[name]
        if q <= 0:
            whole |= {f"{p}n_{name}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)), f"{p}d_{name}": F.when(F.col(c).isNull(), 0.0).otherwise(1.0)}
            continue
        decay = F.pow(F.lit(q), F.col(within) + 1)
        whole |= {f"{p}{kind}_{name}": F.col(f"{p}{kind}_{name}") + decay * F.col(f"{p}c{kind}_{name}") for kind in "nd"}
    out = out.withColumns(whole)
    return out.drop(at, block, within, *carried)
