"""Quality rules: texts too short or too repetitive, and texts that a host's boilerplate lines make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_WS, WS_RUN, join_hashed, key2, lower_ascii, prefix_for, quoted, read_table, strip_ascii

_NO_HOST = "\x00none"


def _chars_less(text: Column, gone: str) -> Column:
    """Code points of text without the ASCII characters `gone`."""
    taken = F.lit(0)
    for ch in gone:
        taken = taken + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(ch), F.lit(""))))
    return F.char_length(text) - taken


def _word_count(line: Column) -> Column:
    bare = strip_ascii(line)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WS_RUN, -1)))


def text_stats(docs: DataFrame, text_col: str = "text", *, window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of `text_col`.

    Words are runs of anything but ASCII white space. n_repeat_words counts words in windows of
    `window` words found at least twice in the text, the first included; windows are told apart by
    64-bit hashes, sorted only where some hash repeats. Null text counts as empty: all five are 0.
    """
    p = prefix_for(docs)
    text = F.coalesce(quoted(text_col), F.lit(""))
    bare = strip_ascii(text)
    c = {x: f"{p}{x}" for x in ("words", "hashes", "wins", "sorted", "pos", "lines")}
    keep = [x for x in docs.columns if x not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    df = docs.select(*(quoted(x) for x in keep), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN, -1)).alias(c["words"]))
    # with no word, or no line feed, there is no repeated line
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip_ascii(x) != "")
    df = df.withColumns({
        "n_words": F.size(c["words"]).cast("long"),
        "word_chars": _chars_less(text, ASCII_WS).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        c["lines"]: F.when(F.contains(text, F.lit("\n")), lines).otherwise(F.array().cast("array<string>")),
        c["hashes"]: F.transform(c["words"], lambda w: F.xxhash64(w)),
    })
    at = lambda i, k: F.get(F.col(c["hashes"]), i + k)
    wins = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - window), lambda i: F.xxhash64(*(at(i, k) for k in range(window))))
    df = df.withColumns({
        "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        c["wins"]: F.when(F.col("n_words") > window, wins),
    }).drop(c["words"], c["hashes"], c["lines"])
    repeated = F.size(F.array_distinct(c["wins"])) < F.size(c["wins"])
    df = df.withColumn(c["sorted"], F.when(repeated, F.sort_array(F.transform(c["wins"], lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(c["wins"])
    h = lambda i: F.get(F.col(c["sorted"]), i)["h"]
    twice = F.filter(
        F.transform(c["sorted"], lambda x, i: F.when((F.coalesce(h(i - 1) == x["h"], F.lit(False))) | (F.coalesce(h(i + 1) == x["h"], F.lit(False))), x["i"])),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn(c["pos"], F.sort_array(twice)).drop(c["sorted"])
    steps = F.transform(c["pos"], lambda x, j: F.least(F.lit(window), F.coalesce(F.get(F.col(c["pos"]), j + 1) - x, F.lit(window))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop(c["pos"])


def host_line_removals(docs: DataFrame, id_col: str, text_col: str, host_col: str, *, min_chars: int, min_docs: int, max_share: float) -> DataFrame:
    """A row (r1, r2, removed_words) for each document that has lines above its host's limits.

    r1, r2: document_key, so rows of equal id, host and text are one document. A line's key is the line stripped of ASCII
    white space with A-Z in lower case. It is above the limits if at least min_docs of the host's distinct documents, and
    more than max_share of them, have it. Only hashes of lines and documents are shuffled; a hot line's documents
    are told apart first, dealt out by both, and then counted in each task. A null host is a host of its own.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    k1, k2 = document_key(id_col, text_col, host_col)
    host = F.coalesce(quoted(host_col).cast("string"), F.lit(_NO_HOST))
    base = docs.select(k1.alias("r1"), k2.alias("r2"), host.alias("host"), text.alias("body"))
    lines = base.select("r1", "r2", "host", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("norm", lower_ascii(strip_ascii(F.col("line")))).where(F.char_length("norm") >= min_chars)
    h1, h2 = key2(F.col("host"), F.col("norm"))
    lines = lines.select("r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"), F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", WS_RUN, -1))).alias("words"))

    each = F.array_distinct(F.transform(F.split("body", "\n", -1), lambda x: lower_ascii(strip_ascii(x))))
    once = base.select("host", "r1", F.explode(each).alias("norm")).where(F.char_length("norm") >= min_chars)
    h1, h2 = key2(F.col("host"), F.col("norm"))
    once = once.select("host", "r1", h1.alias("h1"), h2.alias("h2")).distinct()
    counts = once.groupBy("h1", "h2", "host").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hosts = base.select("host", "r1", "r2").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    above = counts.join(hosts, "host").where(F.col("n") > max_share * F.col("n_docs")).select("h1", "h2")
    found = join_hashed(lines, above, "h1", "h2").groupBy("r1", "r2").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))
    return found.select("r1", "r2", F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("removed_words"))


def document_key(id_col: str, text_col: str, host_col: str) -> tuple[Column, Column]:
    """128 bits that stand for a document: its id, host and text."""
    return key2(quoted(id_col), quoted(host_col), F.coalesce(quoted(text_col), F.lit("")))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_chars: int = 10,
    min_docs: int = 20,
    max_share: float = 0.1,
    min_left: float = 0.3,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent % of the words in
    repeated 8-word windows. Else a document is rejected if, after the lines above its host's limits
    (see host_line_removals) are taken away, less than min_left of its words are left: it is depleted.
    removed_words is what those lines hold.

    Boilerplate that is left: lines of fewer than min_docs documents of a host, so all of hosts with fewer documents
    than that, and lines of at most max_share of a host's documents, however many these are. A line near that share
    everywhere is removed for some hosts and kept for others. How many documents other shares reject isn't measured.

    Null or empty text has no word: base_failed. Equal rows get equal results and are one
    document of their host. A null host is a host. Columns of the names above are replaced; others pass.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    docs = docs.select(*(quoted(c) for c in docs.columns if c not in new))
    p = prefix_for(docs)
    gone = host_line_removals(docs, id_col, text_col, host_col, min_chars=min_chars, min_docs=min_docs, max_share=max_share)
    k1, k2 = document_key(id_col, text_col, host_col)
    stats = text_stats(docs.withColumns({f"{p}a": k1, f"{p}b": k2}), text_col)
    gone = gone.withColumnsRenamed({"r1": f"{p}a", "r2": f"{p}b", "removed_words": f"{p}gone"})
    out = stats.join(gone, [f"{p}a", f"{p}b"], "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    removed = F.coalesce(F.col(f"{p}gone"), F.lit(0)).cast("long")
    out = out.withColumns({"base_failed": failed, "removed_words": removed})
    # one comparison of both sides of the join: a filter on it stays above the join, and the statistics are made once a row
    least = F.when(F.col("base_failed"), F.col("n_words") + 1).otherwise(min_left * F.col("n_words"))
    return out.withColumn("kept", F.col("n_words") - F.col("removed_words") >= least).drop(f"{p}a", f"{p}b", f"{p}gone")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STATS_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), wins AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n >= 2
), steps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice
), rep AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), keyed AS (
  SELECT doc_id, source, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), above AS (
  SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY source, k)
  JOIN (SELECT source, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY source) USING (source)
  WHERE n >= 20 AND n > 0.1 * n_docs
), gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(k, '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM keyed JOIN above USING (source, k) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS removed
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
), judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base
)
"""
OP8_SQL = _STATS_SQL + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words - removed >= 0.3 * n_words) AS kept
FROM judged
"""
