"""Symbol catalogues: (Symbol, Name) from Parquet, CSV or SQLite files, or a built-in list; labels for choosing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = T.StructType([T.StructField("Symbol", T.StringType()), T.StructField("Name", T.StringType())])
#: What a catalogue holds if there is no file. Fixed values.
FALLBACK = [
    ("AAPL", "Apple Inc"), ("TSLA", "Tesla Inc"), ("MSFT", "Microsoft Corp"), ("GOOGL", "Google LLC"), ("AMZN", "Amazon.com Inc"),
    ("META", "Meta Platforms Inc"), ("NVDA", "NVIDIA Corp"), ("NFLX", "Netflix Inc"), ("AMD", "AMD Inc"), ("INTC", "Intel Corp"),
]
SEPARATOR = " - "


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            first = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid LIMIT 1").fetchone()
            if first:
                table = '"' + first[0].replace('"', '""') + '"'
                yield from db.execute(f"SELECT Symbol, Name FROM {table}")


class SqliteCatalogue(DataSource):
    """Symbol and Name of a SQLite file's first table; no rows if it has no table. A catalogue is one small file, which
    every executor must be able to open."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalogue"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options["path"])


def read_catalogue(spark: SparkSession, path: str | None = None, form: str = "parquet") -> DataFrame:
    """(Symbol, Name) of a file, or the built-in list where no path is given. A path that can't be read raises."""
    if path is None:
        return spark.createDataFrame(FALLBACK, SCHEMA)
    if form == "sqlite":
        spark.dataSource.register(SqliteCatalogue)
        return spark.read.format("sqlite_catalogue").option("path", path).load()
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    return reader.format(form).load(path).select(F.col("Symbol").cast("string"), F.col("Name").cast("string"))


def empty_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(catalogue: DataFrame) -> DataFrame:
    """catalogue with label, "Symbol - Name"; rows that lack either, or have an empty one, go."""
    return catalogue.where((F.col("Symbol") != "") & (F.col("Name") != "")).withColumn("label", F.concat_ws(SEPARATOR, "Symbol", "Name"))


def symbol_of(label: str) -> Column:
    """The symbol in a label's column: what stands before its first separator."""
    return F.substring_index(F.col(label), SEPARATOR, 1)


def named(bars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """bars with the symbol's name, null if the catalogue lacks it. The planner broadcasts the catalogue under its size limit."""
    names = catalogue.where(F.col("Symbol").isNotNull()).groupBy(F.col("Symbol").alias("symbol")).agg(F.min("Name").alias("name"))
    return bars.join(names, "symbol", "left")
