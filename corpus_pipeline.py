"""From documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.byte_bpe import bpe_digests, public_ranks
from tickloom.llm.common import key2, prefix_for, read_table, scratch
from tickloom.llm.decontaminate import find_leaks
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.near_dup import near_duplicates
from tickloom.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first of them only; n_chars is counted anew."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near copies stays; of equal rows, one does.

    Texts without words, such as copies whose lines all went, are one class. Rows of one id and different texts are judged by
    their id: all stay if any does.
    """
    p = prefix_for(docs)
    word = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}\p{M}]"), F.lit(False))
    least = docs.where(~word).agg(F.min("doc_id")).first()[0]
    first = near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(f"{p}id")).distinct()
    kept = docs.where(word | F.col("doc_id").eqNullSafe(F.lit(least))).join(first, F.col("doc_id").eqNullSafe(F.col(f"{p}id")), "left_semi")
    h1, h2 = key2(F.col("text"))
    return kept.withColumns({f"{p}1": h1, f"{p}2": h2}).dropDuplicates(["doc_id", f"{p}1", f"{p}2"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token count, and digests of its ids and of the bytes that they decode to."""
    return bpe_digests(docs, *public_ranks())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("byte_bpe", tokens)]

#: SQL has no byte-level BPE, nor near copies by signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents, each written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, name)
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
