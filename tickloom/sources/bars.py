"""Bars: open, high, low, close and volume of each symbol and period, made from ticks or read from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import Series

S = Series()
BARS_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("dt", T.DateType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
])
#: Periods of price history, in months; None: all of it. Fixed values.
PERIODS = {"1y": 12, "2y": 24, "5y": 60, "max": None}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(ticks: DataFrame, symbol: Column, period: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """(symbol, dt, open, high, low, close, volume) of ticks. order tells the ticks of a bar apart, so that open
    and close are the same on every run. Ticks combine in each task before the one shuffle: a hot symbol
    sends a row for each of its bars and tasks."""
    rows = ticks.select(symbol.alias("symbol"), period.alias("dt"), price.alias("p"), order.alias("o"), volume.alias("v"))
    return rows.groupBy("symbol", "dt").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume")
    )


def bars_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily unit prices of line items, a series for each return flag."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars(read_table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.to_date("l_shipdate"), price, key, F.col("l_quantity"))


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order values, a series for each market segment. Both sides grow with the data, so the join is left to
    the planner, which broadcasts customers only under its size limit."""
    rows = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return bars(rows, F.col("c_mktsegment"), F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1))


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event values, a series for each event type."""
    return bars(read_table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), F.col("value"), F.col("event_id"), F.lit(1))


def quote_history(history: DataFrame, symbol: str | None = None, period: str = "2y", s: Series = S) -> DataFrame:
    """The bars of one symbol, or of all, in the last months of each symbol's own history: later than as many months
    before its last bar. The symbol's filter reaches the scan. An unknown symbol gives no rows."""
    rows = history if symbol is None else history.where(F.col(s.key) == symbol)
    months = PERIODS[period]
    if months is None:
        return rows
    last = F.max(s.order).over(s.whole)
    return rows.withColumn("_last", last).where(F.col(s.order) > F.add_months("_last", -months)).drop("_last")


def with_warm_up(history: DataFrame, since: str, rows: int, s: Series = S) -> DataFrame:
    """The bars from `since` on and as many rows before as windows look back: all that finite windows of rows from
    then on need. Exact for rolling columns, not for cumulative ones."""
    numbered = history.withColumn("_before", F.row_number().over(s.backward)).withColumn("_since", F.min(F.when(F.col(s.order) >= F.lit(since), -F.col("_before"))).over(s.whole))
    return numbered.where(F.col("_before") <= rows - F.col("_since")).drop("_before", "_since")


def write_bars(frame: DataFrame, path: str) -> None:
    """Parquet in a folder for each symbol, so that a symbol's filter prunes folders; hot symbols are written by
    several tasks, by year."""
    frame.repartition(F.col("symbol"), F.year("dt")).write.partitionBy("symbol").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS_SCHEMA).parquet(path)
