"""Line dedup: a line found in several documents stays in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hashed, key2, lower_ascii, prefix_for, quoted, read_table, strip_ascii

_LAST = (1 << 63) - 1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with `text_col` less its repeated lines, and two columns more: n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, with A-Z in lower case. A key of at least
    min_chars code points that occurs in at least min_docs documents keeps its lines only in the
    document of the smallest id, where all of them stay. Only hashes (128 bits) and positions of lines
    are shuffled; the counts combine before the shuffle, and a hot line's rows can be split.

    Null or empty text: one empty line; the text becomes empty. A null id counts as one document
    after all others. Rows of the same id are one document. Equal rows get equal results. Columns
    named n_lines or n_dropped are replaced; any other extra columns pass through.
    """
    p = prefix_for(docs)
    a, b, owner, lines, pos, line, h1, h2, first, drop = (f"{p}{x}" for x in ("a", "b", "owner", "lines", "pos", "line", "h1", "h2", "first", "drop"))
    text = F.coalesce(quoted(text_col), F.lit(""))
    k1, k2 = key2(quoted(id_col), text)
    ident = F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST))

    rows = docs.select(k1.alias(a), k2.alias(b), ident.alias(owner), F.posexplode(F.split(text, "\n", -1)).alias(pos, line))
    rows = rows.withColumn(line, lower_ascii(strip_ascii(F.col(line)))).where(F.char_length(line) >= min_chars)
    g1, g2 = key2(F.col(line))
    rows = rows.select(a, b, owner, pos, g1.alias(h1), g2.alias(h2))

    found = rows.groupBy(h1, h2)
    if min_docs == 2:
        shared = found.agg(F.min(owner).alias(first), F.max(owner).alias(f"{p}last")).where(F.col(first) != F.col(f"{p}last"))
    else:
        shared = found.agg(F.min(owner).alias(first), F.countDistinct(owner).alias(f"{p}n")).where(F.col(f"{p}n") >= min_docs)
    hit = join_hashed(rows, shared.select(h1, h2, first), h1, h2).where(F.col(owner) != F.col(first))
    drops = hit.groupBy(a, b).agg(F.collect_set(pos).alias(drop))

    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(*(quoted(c) for c in rest), k1.alias(a), k2.alias(b))
    whole = whole.join(drops, [a, b], "left").withColumn(lines, F.split(text, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return whole.select(
        *(kept.alias(c) if c == text_col else quoted(c) for c in rest),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT doc_id, pos, line, (first_doc IS NOT NULL AND doc_id <> first_doc) AS dropped
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, sum(dropped::BIGINT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
