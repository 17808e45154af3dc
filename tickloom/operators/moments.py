"""Least squares from moments: sums of products over rows of lags, made in every task and added up, and one small system to solve for each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segments import Blocks, rolling, running


def moments(rows: DataFrame, key: str, row: str) -> DataFrame:
    """(key, n, moments) of rows with an array of m doubles each: how many, and the m x m sums of products, row by row.

    Each batch of rows is multiplied at once, and the batches' sums are added before and after the shuffle: a series of any length sends a
    matrix for each task. Rows of a null array don't count.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            each = [x[code == k] for k in range(len(codes.dictionary))]
            grams = np.stack([a.T @ a for a in each]).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                codes.dictionary, pa.array([len(a) for a in each], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(grams), x.shape[1] ** 2).cast(pa.list_(pa.float64())),
            ], names=["key", "n", "gram"])

    some = rows.where(F.col(row).isNotNull()).select(F.col(key).alias("key"), F.col(row).alias("row")).mapInArrow(run, f"key {kind}, n long, gram array<double>")
    added = some.groupBy("key").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("gram")).alias("gram"))
    return added.select(F.col("key").alias(key), "n", vector_to_array("gram").alias("moments"))


def solve(gram: np.ndarray, k: int, y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, sum of squared errors, inverse) of column y on the first k columns, from their moments. Columns are scaled
    first; columns that depend on others share their coefficients (least norm)."""
    a, b, scale = gram[:k, :k], gram[:k, y], np.sqrt(np.maximum(np.diag(gram)[:k], 1e-300))
    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-13, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ b
    return beta, max(0.0, float(gram[y, y] - 2 * beta @ b + beta @ a @ beta)), inverse


def recent(b: Blocks, c: str, n: int, out: str) -> Blocks:
    """b with the array `out` of the last n values of c, the newest first, fewer where there aren't as many yet, and <out>_at: how
    many there have been so far."""
    counted = running(b, {f"{out}_at": ("count", c)})
    made = rolling(counted, {out: (F.collect_list, c, n, 0)})
    return made.of(made.frame.withColumn(out, F.reverse(out)))


def lag_rows(values: Column, lags: Column, most: int, extra: list[Column]) -> Column:
    """[1, *extra, values 1 to most with those after `lags` as 0, value 0]: a row of a regression on lags."""
    value = lambda j: F.coalesce(F.get(values, j), F.lit(0.0))
    past = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: F.when(j <= lags, value(j)).otherwise(0.0)) if most else F.array().cast("array<double>")
    return F.concat(F.array(F.lit(1.0), *extra), past, F.array(value(F.lit(0))))
