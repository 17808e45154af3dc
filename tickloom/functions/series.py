"""Column builders over ordered series: lags, rolling and expanding aggregates, compounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ColumnOrName = Column | str


def column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complete(df: DataFrame) -> DataFrame:
    """The rows that lack no value. A test for each column, and not one of all: the optimizer derives constraints
    from each alias of a tested column, and their number doubles with every alias where one test holds many."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in df.columns)))


@dataclass(frozen=True)
class Series:
    """Rows of one `key`, in the order of `order`; (key, order) is unique.

    All frames count rows, not days. Every builder uses one of two window specifications (key, ascending
    or descending order), so Spark evaluates them after one exchange on the key.
    """

    key: str = "symbol"
    order: str = "dt"

    @property
    def forward(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.order)

    @property
    def backward(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(F.col(self.order).desc())

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.key)

    def number(self) -> Column:
        return F.row_number().over(self.forward)

    def number_from_last(self) -> Column:
        return F.row_number().over(self.backward)

    def lag(self, c: ColumnOrName, k: int = 1) -> Column:
        return F.lag(column(c), k).over(self.forward)

    def lead(self, c: ColumnOrName, k: int = 1) -> Column:
        return F.lead(column(c), k).over(self.forward)

    def diff(self, c: ColumnOrName, k: int = 1) -> Column:
        return column(c) - self.lag(c, k)

    def pct_change(self, c: ColumnOrName, k: int = 1) -> Column:
        """c over its value k rows before, less 1; null where that is null or 0."""
        return F.try_divide(column(c), self.lag(c, k)) - 1

    def rolling(self, agg: Callable[[Column], Column], c: ColumnOrName, n: int) -> Column:
        """agg of the last n values; null until there are n that aren't null."""
        frame = self.forward.rowsBetween(1 - n, 0)
        return F.when(F.count(column(c)).over(frame) >= n, agg(column(c)).over(frame))

    def expanding(self, agg: Callable[[Column], Column], c: ColumnOrName) -> Column:
        return agg(column(c)).over(self.forward.rowsBetween(Window.unboundedPreceding, 0))

    def cumprod(self, c: ColumnOrName) -> Column:
        """The product of the values so far; nulls are skipped and stay null."""
        return F.when(column(c).isNotNull(), self.expanding(F.product, c))

    def compounded(self, returns: ColumnOrName) -> Column:
        """The growth of 1 under the returns so far."""
        return self.cumprod(1 + column(returns))
