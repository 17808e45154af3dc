"""Source divergence audit: how far the word frequencies of each language's sources lie apart, and by which terms."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, read_table, scratch, stored
from .word_hashes import buffer_of, fold_ascii, mix, same_spans, span_hashes, turns

#: Bytes of text whose terms are counted at a time, about.
TURN = 4 << 20
#: Probabilities are whole numbers of this.
UNIT = 1_000_000_000
#: Seats of the tournament: as many rounds less one, whatever the data. Even.
SEATS = 8
#: Entries that one seat's vectors of a block of terms hold, about.
BLOCK = 1 << 18
_CELL = ["lang", "block", "seat"]
_MET = "lang string, source string, item string, value long"


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, n_docs) of docs: how often a term occurs in a group, and in how many of its rows. A group
    without any term has a row of a null term. Terms are counted in each batch before rows are made of them, and in each task before the shuffle."""
    part = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    own = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2, TURN):
                yield _counted(batch)

    counted = own.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of term_counts() for a batch of (lang, source, text). Occurrences meet by a hash of group and term, and each run of equal hashes
    is compared byte by byte with its first; what differs is counted by itself."""
    raw, at = buffer_of(batch.column(2))
    raw = fold_ascii(raw)
    letter = np.concatenate([[False], (raw >= 128) | (raw >= 97) & (raw <= 122), [False]])
    begins, ends = letter[1:-1] & ~letter[:-2], letter[1:-1] & ~letter[2:]
    edge = at[(at > 0) & (at < len(raw))]
    begins[edge] = letter[1:-1][edge]
    ends[edge - 1] = letter[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc, size = np.searchsorted(at, starts, "right") - 1, ends - starts
    names: dict[tuple, int] = {}
    of_doc = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
    group = of_doc[doc]
    key = mix(span_hashes(raw, starts, ends) ^ mix(group.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    run = np.cumsum(first) - 1
    head = order[first][run] if len(order) else order
    same = (size[order] == size[head]) & (group[order] == group[head])
    same[same] = same_spans(raw, starts[order[same]], raw, starts[head[same]], size[order[same]])
    other = order[~same]
    kept, run = order[same], run[same]
    n = np.bincount(run, minlength=int(first.sum()))
    new_doc = np.ones(len(kept), bool)
    new_doc[1:] = (run[1:] != run[:-1]) | (doc[kept[1:]] != doc[kept[:-1]])
    n_docs = np.bincount(run, new_doc, minlength=len(n)).astype(np.int64)

    spans = order[first]
    length = size[spans]
    place = np.arange(int(length.sum())) + np.repeat(starts[spans] - (np.cumsum(length) - length), length)
    offsets = np.zeros(len(spans) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    terms = pa.StringArray.from_buffers(len(spans), pa.py_buffer(offsets), pa.py_buffer(raw[place]))
    groups = group[spans]
    differ: dict[tuple, list] = {}
    for i in other.tolist():
        differ.setdefault((int(group[i]), raw[starts[i] : ends[i]].tobytes().decode()), []).append(int(doc[i]))
    rest = [*differ, *((g, None) for g in sorted(set(names.values()) - set(groups.tolist())))]
    counts = [(len(differ.get(x, [])), len(set(differ.get(x, [])))) for x in rest]
    which = np.concatenate([groups, np.array([g for g, _ in rest], np.int64)])
    held = list(names)
    column = lambda k: pa.array([x[k] for x in held], pa.string()).take(pa.array(which))
    return pa.RecordBatch.from_arrays([
        column(0), column(1), pa.concat_arrays([terms, pa.array([t for _, t in rest], pa.string())]),
        pa.array(np.concatenate([n, np.array([x for x, _ in counts], np.int64)])), pa.array(np.concatenate([n_docs, np.array([x for _, x in counts], np.int64)])),
    ], names=["lang", "source", "term", "n", "n_docs"])


def share_of_unit(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), exactly; n + 1 is at most total. A long division, so that no product leaves 64 bits."""
    if total >= 1 << 59:
        raise ValueError(f"{total} terms are too many for exact shares")
    base, digits = (1000, 3) if total < 1 << 53 else (10, 9)
    rest, out = n.astype(np.int64) + 1, np.zeros(len(n), np.int64)
    for _ in range(digits):
        rest = rest * base
        out = out * base + rest // total
        rest %= total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so a square fits into 64 bits."""
    d = p - q
    return d * d // q


def pack(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids and their counts, as gaps, compressed."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), n]).astype("<i8").tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(blob), "<i8")
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def top_terms(n: np.ndarray, lang_n: np.ndarray, terms: list[str], total: int, lang_total: int, k: int) -> list[tuple[int, str]]:
    """The k first (-value, term) of a group's terms whose share is above the language's, by a heap."""
    p, q = share_of_unit(n, total), share_of_unit(lang_n, lang_total)
    on = np.flatnonzero((n > 0) & (p > q))
    value = distance(p[on], q[on])
    if len(on) > k:
        least = np.partition(value, len(on) - k)[len(on) - k]
        on, value = on[value >= least], value[value >= least]
    first = heapq.nsmallest(k, ((-v, terms[i].encode(), i) for v, i in zip(value.tolist(), on.tolist(), strict=True)))
    return [(v, terms[i]) for v, _, i in first]


def vectors(entries: DataFrame, k: int) -> DataFrame:
    """A row for each lang, block and source of entries: its counts as a compressed vector over the block's term ids, and its k top
    terms of the block. entries: (lang, block, source, seat, total, v, lang_n, id, term, n, lang_count, block_v); one row of
    each group has no id and says how many terms the block has."""
    schema = "lang string, block int, source string, seat int, total long, block_v long, vector binary, top array<struct<value: long, item: string>>"
    kinds = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("source", pa.string()), ("seat", pa.int32()), ("total", pa.int64()), ("block_v", pa.int64()), ("vector", pa.binary()),
                       ("top", pa.list_(pa.struct([("value", pa.int64()), ("item", pa.string())])))])

    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("lang", "block", "source", "seat", "total", "lang_total")}
        block_v = max(x for x in table.column("block_v").to_pylist() if x is not None)
        table = table.filter(table.column("id").is_valid()).sort_by("id")
        ids, n, lang_n = (table.column(c).to_numpy() for c in ("id", "n", "lang_count"))
        top = top_terms(n, lang_n, table.column("term").to_pylist(), first["total"], first["lang_total"], k) if len(ids) else []
        row = {c: [first[c]] for c in ("lang", "block", "source", "seat", "total")}
        return pa.table(row | {"block_v": [block_v], "vector": [pack(ids, n)], "top": [[{"value": -v, "item": t} for v, t in top]]}, schema=kinds)

    return entries.groupBy("lang", "block", "source").applyInArrow(run, schema)


def _held(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in ("source", "total", "block_v", "vector")), strict=True))


def both_ways(a: tuple, b: tuple) -> tuple[int, int]:
    """The summed distances of a to b and of b to a over the block's terms; a and b: (ids, n, total), and the block's number of terms."""
    (ids_a, n_a, total_a, v), (ids_b, n_b, total_b, _) = a, b
    if not v:
        return 0, 0
    ids = np.union1d(ids_a, ids_b)
    sides = []
    for own, n, total in ((ids_a, n_a, total_a), (ids_b, n_b, total_b)):
        counts = np.zeros(len(ids) + 1, np.int64)  # the last one stands for all terms that neither has
        counts[np.searchsorted(ids, own)] = n
        sides.append(share_of_unit(counts, total))
    times = v - len(ids)
    p, q = sides
    return tuple(int(f[:-1].sum()) + times * int(f[-1]) for f in (distance(p, q), distance(q, p)))


def _meet(lang: str, homes: list[tuple], guests: list[tuple] | None) -> pa.Table:
    """Rows of _MET for each of homes with each of guests; without guests, of the homes among themselves."""
    opened = [(s, (*unpack(blob), total, v)) for s, total, v, blob in homes]
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
    for k, (source, total, v, blob) in enumerate(homes if guests is None else guests):
        own = opened[k][1] if guests is None else (*unpack(blob), total, v)
        for peer, vector in opened[:k] if guests is None else opened:
            there, back = both_ways(own, vector)
            out["source"] += [source, peer]
            out["item"] += [peer, source]
            out["value"] += [there, back]
    out["lang"] = [lang] * len(out["source"])
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def partner(seat: Column, turn: int, seats: int = SEATS) -> Column:
    """The seat that a seat meets in a turn of a round-robin tournament of an even number of seats (the circle method)."""
    last = seats - 1
    other = F.pmod(F.lit(2 * turn) - seat, F.lit(last))
    return F.when(seat == last, turn % last).when(other == seat, last).otherwise(other).cast("int")


def rotate(held: DataFrame, seats: int = SEATS) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of a language's sources, value for each block of terms.

    held: vectors(). Each seat's vectors of a language and block stay in their partition, kept on disk there (and made again
    from held if an executor is lost). In each turn half of the seats stay, and the other seats' compressed vectors travel to their
    partners', where both directions of each pair are worked out. First the sources of each seat meet one another. There
    are `seats` turns whatever the data; more blocks, not more turns, serve larger vocabularies and more sources.
    """
    spark = held.sparkSession
    path = scratch(spark, "met")
    home = held.select(*_CELL, "source", "total", "block_v", "vector").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_CELL).persist(StorageLevel.DISK_ONLY)

    def alone(table: pa.Table) -> pa.Table:
        return _meet(table.column("lang")[0].as_py(), _held(table), None)

    def together(key: tuple, stay: pa.Table, come: pa.Table) -> pa.Table:
        return _meet(key[0].as_py(), _held(stay), _held(come))

    try:
        home.groupBy(*_CELL).applyInArrow(alone, _MET).write.mode("append").parquet(path)
        for turn in range(seats - 1):
            to = partner(F.col("seat"), turn, seats)
            # of two partners, now the lower seat stays, now the higher
            stays = F.when((F.col("seat") + to) % 2 == 0, F.col("seat") < to).otherwise(F.col("seat") > to)
            hosts, guests = home.where(stays), home.where(~stays).withColumn("seat", to)
            hosts.groupBy(*_CELL).cogroup(guests.groupBy(*_CELL)).applyInArrow(together, _MET).write.mode("append").parquet(path)
    finally:
        home.unpersist()
    return spark.read.schema(_MET).parquet(path)


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, min_docs: int = 3, top: int = 200, block: int = BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of rows of a language and source.

    Terms are runs of letters, everything beyond ASCII being one, A-Z in lower case. Each language keeps those in at least min_docs of its rows, V in number. The
    share of a kept term in a group, or in the whole language, is p = 1 + floor(UNIT * (n + 1) / (N + V)), of its n
    and all kept terms' N occurrences there; f = floor((p - q)^2 / q). Part "pair": item is each other source of
    the language, value f of the group's shares to that source's, summed over all kept terms. Part "term": items are the group's kept
    terms whose share is above the language's, value is f to that, the `top` first. Rank: value descending, item ascending.

    Vectors are cut into blocks of terms, so that no task holds a whole vector however large the
    vocabulary is; ids of terms are numbers within a block. A null text, language or source is ''. Rows are documents, equal ones too. A
    language without kept terms has pairs of value 0. A group without terms is a group. A single source has no pairs.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "counts")
    vocabulary = (
        counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n_docs").alias("df"), F.sum("n").alias("lang_count"), F.count("*").alias("n_sources"))
        .where(F.col("df") >= min_docs).drop("df")
    )
    vocabulary = stored(vocabulary, "vocabulary")
    size = F.count("*").alias("v"), F.sum("lang_count").alias("lang_n"), F.sum("n_sources").alias("n_entries")
    langs = counts.select("lang").distinct().join(vocabulary.groupBy("lang").agg(*size), "lang", "left").na.fill(0, ["v", "lang_n", "n_entries"])
    blocks = F.greatest(F.lit(1), F.ceil((F.col("v") + F.col("n_entries") / SEATS) / block)).cast("int")
    langs = stored(langs.select("lang", "v", (F.col("lang_n") + F.col("v")).alias("lang_total"), blocks.alias("blocks")), "langs")

    # joined by a column of its own, so that what follows is dealt out by block too and not by language or group alone
    own, by_lang, by_group = Window.partitionBy("lang", "block"), F.concat("lang", F.lit("\0")).alias("by"), F.concat("lang", F.lit("\0"), "source").alias("by")
    placed = vocabulary.select("*", by_lang).join(langs.select("blocks", by_lang), "by").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    placed = stored(placed.select("lang", "term", "block", "lang_count", (F.row_number().over(own.orderBy("term")) - 1).cast("long").alias("id")), "ids")
    kept = stored(counts.where(F.col("term").isNotNull()).join(placed, ["lang", "term"]).select("lang", "source", "term", "block", "id", "n", "lang_count"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("size"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang")
    # the largest sources are dealt first, so that seats hold about as much
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("size").desc_nulls_last(), "source")) - 1
    groups = stored(groups.select("lang", "source", (nth % SEATS).cast("int").alias("seat"), (F.coalesce("group_n", F.lit(0)) + F.col("v")).alias("total"), "lang_total", "blocks"), "groups")

    none = lambda c, t: F.lit(None).cast(t).alias(c)
    per_block = placed.groupBy("lang", "block").agg(F.count("*").alias("block_v"))
    every = groups.select("lang", "source", "seat", "total", "lang_total", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(per_block, ["lang", "block"], "left")
    every = every.select("lang", "block", "source", "seat", "total", "lang_total", none("id", "long"), none("term", "string"), none("n", "long"), none("lang_count", "long"), F.coalesce("block_v", F.lit(0)).alias("block_v"))
    entries = kept.select("*", by_group).join(groups.select("seat", "total", "lang_total", by_group), "by").select("lang", "block", "source", "seat", "total", "lang_total", "id", "term", "n", "lang_count", none("block_v", "long"))
    held = stored(vectors(entries.unionByName(every), top), "vectors")

    pairs = rotate(held).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = held.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", "t.item", "t.value", F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = ("lang", "source", "part", "item", "value")
    return pairs.select(*columns, rank).unionByName(terms.select(*columns, rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT k, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS n FROM found GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(f.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 1)) // (coalesce(t.n, 0) + l.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
QUALIFY part = 'pair' OR rank <= 200
"""
