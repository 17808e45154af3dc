"""Substring dedup: words in windows that occur more than once in the corpus, found by FM-indexes of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import fragments, run_hashes
from .common import key2, quoted, read_table, scratch
from .fm_index import FMIndex
from .word_hashes import turns, word_hashes

_U = np.uint64
#: Words of a shard, about: an index of so many takes some hundred MB for a while.
SHARD_WORDS = 1 << 20
#: An anchor with more distinct fragments than this has its windows dealt out one by one.
HOT = 64
#: Bytes of a word's hash that travel: different windows look equal with a chance of 2**-40.
_CODE = 5
_LOW = (1 << 24) - 1


def _store(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder, and read that."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, anchor, frag, place) of every fragment of docs(a, b, text): hashes of the document, the anchor and the
    fragment's words; place packs 24 more bits of the document, the first word (32 bits) and the windows (8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2):
                words, bounds = word_hashes(batch.column(2))
                anchor, first, count, text = fragments(words, bounds, window, gram)
                a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                place = (b[text] & _LOW) << 40 | (first - bounds[text]) << 8 | count
                frag = run_hashes(words, first, count + window - 1)
                yield pa.RecordBatch.from_arrays([pa.array(a[text]), pa.array(anchor.view(np.int64)), pa.array(frag.view(np.int64)), pa.array(place)], names=["a", "anchor", "frag", "place"])

    return docs.select("a", "b", "text").mapInArrow(run, "a long, anchor long, frag long, place long")


def _codes(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :_CODE])


def units(docs: DataFrame, wanted: DataFrame, window: int, *, hot: bool) -> DataFrame:
    """The words of wanted fragments of docs(key..., text, hits): (anchor, frag, off, w1, w2, count, weight, codes).

    With hot, a row for each window of the hot fragments, w1 and w2 its hash; else a row for each of the others.
    """
    at = docs.columns.index("text")
    both = docs.join(wanted, ["a", "c"])
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["anchor", "frag", "off", "w1", "w2", "count", "weight", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, at):
                words, bounds = word_hashes(batch.column(at))
                lists = batch.column(batch.schema.names.index("hits"))
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                anchor, frag, first, count, weight, is_hot = (np.asarray(flat.field(k)) for k in ("anchor", "frag", "first", "count", "weight", "hot"))
                start = np.repeat(bounds[:-1], size) + first
                keep = np.flatnonzero(is_hot == hot)
                anchor, frag, count, weight, start = anchor[keep], frag[keep], count[keep], weight[keep], start[keep]
                off = np.zeros(len(keep), np.int64)
                if hot:
                    n = count
                    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    anchor, frag, weight, start = np.repeat(anchor, n), np.repeat(frag, n), np.repeat(weight, n), np.repeat(start, n) + off
                    count = np.ones(len(off), np.int64)
                length = count + window - 1
                w1 = run_hashes(words, start, length)
                w2 = run_hashes(words ^ _U(0xA5A5A5A5A5A5A5A5), start, length) if hot else w1
                place = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
                raw = _codes(words[place]).reshape(-1)
                ends = np.zeros(len(length) + 1, np.int32)
                np.cumsum(length * _CODE, out=ends[1:])
                codes = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                columns = (anchor, frag, off, w1.view(np.int64), w2.view(np.int64), count, weight)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), codes], names=names)

    return both.mapInArrow(run, "anchor long, frag long, off long, w1 long, w2 long, count long, weight long, codes binary")


def search(shards: DataFrame, window: int) -> DataFrame:
    """(k1, k2, mask) of those rows of shards(shard, k1, k2, count, weight, codes) with a window that occurs twice in their
    shard; bit i of mask is window i. A shard is indexed and streamed by one task."""

    def run(table: pa.Table) -> pa.Table:
        codes = table.column("codes").combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        length = np.diff(np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]) // _CODE
        lo = int(np.frombuffer(codes.buffers()[1], np.int32)[codes.offset])
        raw = np.frombuffer(codes.buffers()[2], np.uint8)[lo : lo + int(length.sum()) * _CODE].reshape(-1, _CODE)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :_CODE] = raw
        index = FMIndex(wide.view("<i8").reshape(-1), length.astype(np.int64), table.column("weight").to_numpy(), window)
        mask = index.repeated()
        hit = pa.array(np.flatnonzero(mask))
        return pa.table({"k1": table.column("k1").take(hit), "k2": table.column("k2").take(hit), "mask": pa.array(mask[mask != 0])})

    return shards.groupBy("shard").applyInArrow(run, "k1 long, k2 long, mask long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35, gram: int = 8) -> DataFrame:
    """docs with `text_col` less its repeated words, and n_words and n_removed (long).

    Words are runs of anything but ASCII white space. A window is `window` words in a row of one document; if the same words start
    anywhere else too, in this document or another, all words of the window go. Windows are judged on the input. The words
    left are joined by single spaces.

    Every window belongs to a fragment named by an anchor that its own words decide (anchors.fragments), so
    equal windows meet under one anchor. Anchors that occur once are gone after one count. Of the others, each distinct fragment is
    taken once, with its occurrences as weight, and dealt to a shard by its anchor. A shard's FM-index is searched with the
    shard's fragments themselves (fm_index). Where an anchor has many distinct fragments, such as at the edges of a passage that
    many documents hold, its windows are dealt out singly. So a shard has a bounded size however hot its anchors are.

    Null or empty text: no words, and the text becomes empty. Rows of equal id and text are documents of their own that repeat
    each other. Null ids are ids. Columns n_words and n_removed are replaced; other columns pass through.
    """
    spark = docs.sparkSession
    docs = docs.select(*(quoted(c) for c in docs.columns if c not in ("n_words", "n_removed")))
    text = F.coalesce(quoted(text_col), F.lit(""))
    a, b = key2(quoted(id_col), text)
    named = docs.select(F.struct(*(quoted(c) for c in docs.columns if c != text_col)).alias("rest"), text.alias("text"), a.alias("a"), b.alias("b"))

    found = occurrences(named, window, gram)
    twice = found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("other"))
    # xor, so that neither side of the join is dealt out by the key already and hot anchors can be split
    some = found.withColumn("other", F.col("anchor").bitwiseXOR(F.lit(1))).join(twice, "other").drop("other")
    some = _store(some, "fragments")
    distinct = some.groupBy("anchor", "frag").agg(F.min(F.struct("a", "place")).alias("at"), F.count("*").alias("weight"))
    distinct = _store(distinct.select("anchor", "frag", F.col("at.a").alias("a"), F.col("at.place").alias("place"), "weight"), "distinct")
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("other"), F.lit(True).alias("is_hot"))
    marked = distinct.withColumn("other", F.col("anchor").bitwiseXOR(F.lit(1))).join(hot, "other", "left")
    first, count, low = F.shiftrightunsigned("place", 8).bitwiseAND(F.lit((1 << 32) - 1)), F.col("place").bitwiseAND(F.lit(255)), F.shiftrightunsigned("place", 40)
    hit = F.struct("anchor", "frag", first.alias("first"), count.alias("count"), "weight", F.coalesce("is_hot", F.lit(False)).alias("hot"))
    wanted = marked.groupBy("a", low.alias("c")).agg(F.collect_list(hit).alias("hits"))
    # words as they lie in shards: a hot fragment's stand there once a window
    total = marked.agg(F.sum(F.when(F.col("is_hot"), count * window).otherwise(count + window - 1))).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_WORDS))

    keyed = named.select("a", F.col("b").bitwiseAND(F.lit(_LOW)).alias("c"), "rest", "text")
    cold = units(keyed, wanted, window, hot=False).select("anchor", F.col("anchor").alias("k1"), F.col("frag").alias("k2"), "count", "weight", "codes")
    windows = units(keyed, wanted, window, hot=True)
    once = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("weight"), F.first("codes").alias("codes"))
    once = once.select(F.col("w1").alias("anchor"), F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.lit(1).cast("long").alias("count"), "weight", "codes")
    shard = lambda df: df.select(F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard"), "k1", "k2", "count", "weight", "codes")
    masks = search(shard(cold), window)
    repeated = search(shard(once), window).select("k1", "k2")
    again = windows.select("anchor", "frag", "off", "w1", "w2").join(repeated.select(F.col("k1").alias("w1"), F.col("k2").alias("w2")), ["w1", "w2"])
    again = again.groupBy("anchor", "frag").agg(F.bit_or(F.expr("shiftleft(1L, cast(off as int))")).alias("mask"))
    masks = _store(masks.unionByName(again.withColumnsRenamed({"anchor": "k1", "frag": "k2"})), "masks")

    few = masks.select(F.xxhash64("k1", "k2").alias("key"), "k1", "k2", "mask")
    many = some.withColumn("key", F.xxhash64("anchor", "frag"))
    same = (many["key"] == few["key"]) & (many["anchor"].bitwiseXOR(few["k1"]) == 0) & (many["frag"].bitwiseXOR(few["k2"]) == 0)
    gone = many.join(few, same).groupBy("a", low.alias("c")).agg(F.collect_list(F.struct(first.alias("first"), "mask")).alias("gone"))
    return _less(keyed.join(gone, ["a", "c"], "left"), docs, text_col, window)


def _less(both: DataFrame, docs: DataFrame, text_col: str, window: int) -> DataFrame:
    fields = [T.StructField("rest", both.schema["rest"].dataType), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    span = np.arange(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                lists = batch.column(2)
                ends, flat = np.asarray(lists.offsets), lists.values
                first, mask = np.asarray(flat.field("first")), np.asarray(flat.field("mask"))
                has = np.asarray(lists.is_valid())
                kept, n_words, n_gone = [], [], []
                for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    words = raw.split()  # bytes part at ASCII white space
                    n, lost = len(words), 0
                    if has[i] and ends[i + 1] > ends[i]:
                        at, bits = np.nonzero(mask[ends[i] : ends[i + 1], None] >> span & 1)
                        starts = first[ends[i] : ends[i + 1]][at] + bits
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, starts, 1)
                        np.add.at(step, starts + window, -1)
                        stay = np.cumsum(step[:-1]) == 0
                        lost = n - int(stay.sum())
                        words = [words[k] for k in np.flatnonzero(stay).tolist()]
                    kept.append(b" ".join(words))
                    n_words.append(n)
                    n_gone.append(lost)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64())], names=["rest", "kept", "n_words", "n_removed"])

    out = both.select("rest", "text", "gone").mapInArrow(run, T.StructType(fields))
    own = [F.col("kept").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*own, "n_words", "n_removed")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 34)) AS h, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS m
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), rep AS (SELECT h, m FROM win GROUP BY h, m HAVING count(*) >= 2),
starts AS (SELECT doc_id, i FROM win SEMI JOIN rep USING (h, m)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
judged AS (
  SELECT word.doc_id, word.i, x, coalesce(s.i >= word.i - 34, false) AS gone
  FROM word ASOF LEFT JOIN starts s ON word.doc_id = s.doc_id AND word.i >= s.i
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
