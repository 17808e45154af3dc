"""Filter interaction audit: every order of a set of filters replayed over the documents, and what each step did."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS_RUN, join_hashed, key2, prefix_for, quoted, read_table, strip_ascii

_LAST = (1 << 63) - 1
#: More filters than this have too many orders to send to every task: 720 rows are sent at most.
MOST_FILTERS = 6
FILTERS = "ABCDE"
#: What the audit counts at each step, in order.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, places, steps) of all orders of the letters: places has each letter's step, steps each step and the bit
    of its letter. As many rows as the factorial of the letters' number, whatever the data."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed, not {letters!r}")
    rows = [("".join(o), [o.index(x) + 1 for x in letters], [(k + 1, 1 << letters.index(x)) for k, x in enumerate(o)]) for o in itertools.permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, places array<int>, steps array<struct<step: int, bit: int>>")


def replay(flags: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, *COUNTS, shapley) of flags(part, fails, good, toxic): a row for each part, order of the
    filters and step.

    Bit k of fails says that the document fails filter letters[k]. Each document meets each order, its first failure there
    is where it is removed, and its steps are counted before anything is shuffled: a task sends a row for each of its parts,
    orders and steps, however many documents a part has. kept: documents left after the step; removed: here; redundant: fail the step's
    filter but went earlier; unique_fails: fail no other; good_lost and toxic_lost: good or toxic ones removed
    here; shapley: what the step's filter removes, summed over all orders. An empty table has no parts and no rows.
    """
    table = orders(flags.sparkSession, letters)
    played = flags.crossJoin(F.broadcast(table))
    failed = [F.when(F.col("fails").bitwiseAND(1 << k) != 0, F.col("places")[k]) for k in range(len(letters))]
    first = F.coalesce(*failed) if len(failed) == 1 else F.least(*failed)
    played = played.select("part", "fails", "good", "toxic", "filter_order", F.coalesce(first, F.lit(len(letters) + 1)).alias("first"), F.explode("steps").alias("s"))
    step, bit, at = F.col("s.step"), F.col("s.bit"), F.col("first")
    counts = played.groupBy("part", "filter_order", step.alias("step")).agg(
        F.count_if(at > step).alias("kept"),
        F.count_if(at == step).alias("removed"),
        F.count_if((F.col("fails").bitwiseAND(bit) != 0) & (at < step)).alias("redundant"),
        F.count_if(F.col("fails") == bit).alias("unique_fails"),
        F.count_if((at == step) & F.col("good")).alias("good_lost"),
        F.count_if((at == step) & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.expr("substring(filter_order, step, 1)")
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter))).select("part", "filter_order", "step", *COUNTS, "shapley")


def text_conditions(text: Column) -> dict[str, Column]:
    """Of columns holding a text, its words and its distinct words' number: the filters A to D, true where a document fails."""
    words, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return {
        "A": words < 50,
        "B": 100 * distinct < 65 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic) of each row of docs.

    Failure: A: under 50 words (runs of anything but ASCII white space); B: under 65 % of the words distinct, as they are
    written; C: over 5 % of the code points in A-Z; D: any of #$%&*|; E: some row of a smaller id has the same text.
    A null text is empty, a null part ''. A null id is greater than all others. Rows of equal id and text don't fail E by each other.
    good and toxic: some row of labels with the id has quality 1, toxic 1. Of the texts, 128-bit hashes are
    shuffled; texts of one id only go no further, and a text's rows can be split however many they are.
    """
    p = prefix_for(docs)
    text = F.coalesce(quoted(text_col), F.lit(""))
    bare, (h1, h2) = strip_ascii(F.col("_text")), key2(F.col("_text"))
    own = docs.select(F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), quoted(id_col).cast("long").alias(f"{p}id"), text.alias("_text"))
    own = own.withColumns({"id": F.coalesce(f"{p}id", F.lit(_LAST)), "h1": h1, "h2": h2})
    shared = own.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") != F.col("last")).select("h1", "h2", "first")
    worded = own.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN, -1)))
    conditions = text_conditions(F.col("_text"))
    fails = sum((F.when(c, 1 << FILTERS.index(x)).otherwise(0) for x, c in conditions.items()), F.lit(0))
    flagged = worded.select("part", f"{p}id", "id", "h1", "h2", fails.alias("fails"))

    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    judged = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col("doc_id").cast("long").alias(f"{p}label")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    flagged = flagged.join(judged, F.col(f"{p}id") == F.col(f"{p}label"), "left")
    flagged = join_hashed(flagged, shared, "h1", "h2", "left")
    copy = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return flagged.select("part", (F.col("fails") + copy).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """replay() of document_flags(): what the filters A to E do in each of their 120 orders, for each part of docs."""
    return replay(document_flags(docs, labels, id_col, text_col, part_col))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_interactions(docs, read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), judged AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN judged USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), bits AS (
  SELECT filter_order, [1 << (ascii(filter_order[k]) - 65) for k in range(1, 6)] AS bits FROM orders
), played AS (
  SELECT part, fails, good, toxic, filter_order, bits, coalesce(list_position([(fails & b) <> 0 for b in bits], true), 6) AS first FROM flags, bits
), steps AS (
  SELECT part, fails, good, toxic, filter_order, first, step, bits[step] AS bit FROM played, (SELECT unnest(generate_series(1, 5)) AS step)
), counts AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
         count(*) FILTER (WHERE (fails & bit) <> 0 AND first < step) AS redundant, count(*) FILTER (WHERE fails = bit) AS unique_fails,
         count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM counts
"""
