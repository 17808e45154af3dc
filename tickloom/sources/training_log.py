"""Training logs: tab-separated metric files and JSON files with a row for each iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "iter INT, value DOUBLE"
JSON = "meta STRUCT<launch_mode: STRING, iteration_count: INT>, iterations ARRAY<STRUCT<learn: ARRAY<DOUBLE>, iteration: INT, passed_time: DOUBLE, remaining_time: DOUBLE>>"


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(iter, value) of a tab-separated file with a heading."""
    return spark.read.schema(METRICS).csv(path, sep="\t", header=True)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, learn, passed_time, remaining_time) of a JSON file."""
    one = spark.read.schema(JSON).json(path, multiLine=True).select(F.explode("iterations").alias("i"))
    return one.select("i.iteration", F.get("i.learn", F.lit(0)).alias("learn"), "i.passed_time", "i.remaining_time")
