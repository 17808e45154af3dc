"""Helpers that the operators share: tables, row keys, joins that skew can't stall, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it: space and 09-0D.
ASCII_WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is
    set, a local session (tests) makes one of its own, and a cluster's raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later steps don't recompute it, and lost
    executors cost nothing but a reread."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: as recoverable as cut(), with columns that are compressed and read one by one."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prefix_for(*frames: DataFrame) -> str:
    """A column prefix that no column of the frames has, so that extra columns can't clash."""
    names = [c.lower() for f in frames for c in f.columns]
    p = "_t"
    while any(c.startswith(p) for c in names):
        p += "_"
    return p


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def key2(*cols: Column) -> tuple[Column, Column]:
    """128 bits that stand for the values, as two independently seeded hashes."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def strip_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_WS))


def join_hashed(many: DataFrame, few: DataFrame, h1: str, h2: str, how: str = "inner") -> DataFrame:
    """Join on two hash columns so that a hot key can be split.

    Only the first hash is an equi-key: the second is a residual condition. So neither side's earlier
    partitioning fits, both sides get an exchange of their own, and adaptive execution can split a
    hot partition of `many` over several tasks.
    """
    few = few.withColumnsRenamed({h1: "_few_1", h2: "_few_2"})
    on = (many[h1] == few["_few_1"]) & (many[h2].bitwiseXOR(few["_few_2"]) == 0)
    return many.join(few, on, how).drop("_few_1", "_few_2")


def filesystem(path: str):
    """(file system, path in it) of a path or address, for tasks that read or write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
