"""Near-duplicate classes: DartMinHash signatures of weighted shingles, banded joins, exact checks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_hashed, key2, quoted, read_table
from .word_hashes import gram_hashes, mix, turns, word_hashes

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Length of the first time cell; later cells double up to _LONGEST.
_FIRST, _LONGEST = 2.0**-6, 16.0
_LAST = (1 << 63) - 1
#: How many times each text of a torn bucket tries one partner before all pairs still apart are made; results don't depend on it.
ROUNDS = 1


def _cells(upto: float, first: float) -> Iterator[tuple[int, float, float]]:
    """(number, start, length) of cells that cover [0, upto): the same cells whatever upto is."""
    k, lo, size = 0, 0.0, first
    while lo < upto:
        yield k, lo, size
        k, lo = k + 1, lo + size
        size = min(_LONGEST, lo)


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson variable, up to where it is 1 in doubles."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    logs = -mean + n * math.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


def _times(n: int) -> np.uint64:
    return _U(0x9E3779B97F4A7C15 * n % (1 << 64))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """(n_sets, k) signatures of weighted sets: element i, of weight weights[i], belongs to sets[i].

    Every element has darts of its own, scattered by hashing with unit density over (weight, time): a
    dart below the element's weight hits the set's region. Each dart names a coordinate, and the earliest
    hit of a coordinate is its value; two sets agree in a coordinate with the probability of
    their weighted Jaccard similarity. Only darts up to a time are looked at, in cells that all sets
    share: time t / (total weight) shows about t = k ln k + 4 k hits, so a set costs its elements and
    O(k log k). Sets with a coordinate that was not hit look on, to twice the time. Rows of sets with
    no weight stay empty (all ones).
    """
    out = np.full((n_sets, k), _EMPTY, _U)
    total = np.bincount(sets, weights, n_sets)
    upto = np.where(total > 0, (k * math.log(k) + 4 * k) / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    e, w, s = elements, weights, sets
    while len(todo):
        _throw(e, w, s, upto[s], k, out.reshape(-1))
        todo = todo[(out[todo] == _EMPTY).any(axis=1)]
        upto[todo] *= 2
        if len(todo):
            again = np.zeros(n_sets, bool)
            again[todo] = True
            e, w, s = elements[again[sets]], weights[again[sets]], sets[again[sets]]
    return out


def _throw(e: np.ndarray, w: np.ndarray, s: np.ndarray, upto: np.ndarray, k: int, out: np.ndarray) -> None:
    for u, low, tall in _cells(float(w.max()), 1.0):
        in_row = w > low
        eu, wu, su, tu = (e, w, s, upto) if in_row.all() else (e[in_row], w[in_row], s[in_row], upto[in_row])
        for v, start, long in _cells(float(tu.max()), _FIRST):
            on = tu > start
            if not on.all():
                eu, wu, su, tu = eu[on], wu[on], su[on], tu[on]
            cell = mix(eu + _times(1 + u * 4096 + v))
            hits = np.searchsorted(_poisson(tall * long), _unit(cell), "right")
            at = np.flatnonzero(hits)
            n = hits[at]
            each = np.repeat(at, n)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(cell[each] + _GOLD * (nth.astype(_U) + _U(1)))
            time = start + long * _unit(mix(dart + _GOLD))
            keep = time < tu[each]
            if not (tall == 1.0 and low == 0.0 and float(wu.min(initial=1.0)) >= 1.0):
                keep &= low + tall * _unit(mix(dart + _times(2))) < wu[each]
            dart, time, each = dart[keep], time[keep], each[keep]
            # float32 of a positive time sorts as its bits
            value = time.astype(np.float32).view(np.uint32).astype(_U) << _U(32) | dart >> _U(32)
            np.minimum.at(out, su[each] * k + (dart & _U(0xFFFFFFFF)).astype(np.int64) % k, value)


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes and how often each occurs; fewer words than `size`
    are one shingle."""
    grams = gram_hashes(words, size) if len(words) >= size else gram_hashes(words, len(words))
    return np.unique(grams, return_counts=True)


def _words(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(batch.column(column), fold=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, *, bands: int, rows: int, size: int) -> DataFrame:
    """(id, node, bands): node is a 128-bit name of the text's words in order, null if it has none; bands
    are hashes of the signature's bands. Texts of equal words are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        salt = _GOLD * np.arange(1, bands + 1, dtype=_U)
        for whole in batches:
            for batch in turns(whole, 1, 2 << 20):
                words, at = _words(batch, 1)
                elements, weights, owner, nodes, offsets = [], [], [], [], at.tolist()
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if a == b:
                        nodes.append(None)
                        continue
                    own, n = shingles(words[a:b], size)
                    elements.append(own)
                    weights.append(n)
                    owner.append(np.full(len(own), i))
                    nodes.append(hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest())
                if elements:
                    made = dart_signatures(np.concatenate(elements), np.concatenate(weights).astype(float), np.concatenate(owner), batch.num_rows, k)
                else:
                    made = np.full((batch.num_rows, k), _EMPTY, _U)
                parts = made.reshape(batch.num_rows, bands, rows)
                band = np.tile(salt, (batch.num_rows, 1))
                for r in range(rows):
                    band = mix(band * _U(0x9FB21C651E98DF25) + parts[:, :, r])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), lists], names=["id", "node", "bands"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).mapInArrow(run, "id long, node binary, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, *, size: int) -> DataFrame:
    """pairs(x, y), or pairs(p, q) of the 64-bit hashes of names, as (x, y, sim): sim is the weighted Jaccard similarity of the
    shingles of texts(node, text)."""
    px, py, key = ("x", "y", F.col("node")) if "x" in pairs.columns else ("p", "q", F.xxhash64("node"))
    at_y, at_x = (texts.select(key.alias(at), F.struct("node", "text").alias(end)) for at, end in ((py, "end_y"), (px, "end_x")))
    both = pairs.select(px, py).join(at_y, py).join(at_x, px).select(F.col("end_x.node").alias("x"), F.col("end_y.node").alias("y"), F.col("end_x.text").alias("text_x"), F.col("end_y.text").alias("text_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2, 2 << 20):
                (wx, ax), (wy, ay) = _words(batch, 2), _words(batch, 3)
                sims, held = [], (None, None)
                for i, name in enumerate(batch.column(0).to_pylist()):
                    if held[0] != name:
                        held = name, shingles(wx[ax[i] : ax[i + 1]], size)
                    (p, m), (q, n) = held[1], shingles(wy[ay[i] : ay[i + 1]], size)
                    _, here, there = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                    common = int(np.minimum(m[here], n[there]).sum())
                    sims.append(common / max(1, int(m.sum()) + int(n.sum()) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["x", "y", "sim"])

    return both.select("x", "y", "text_x", "text_y").mapInArrow(run, "x binary, y binary, sim double")


def components(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges(x, y): the least (rep, node) of the node's component.

    Rounds of taking the least label of the neighbours and then the label's own label, until none
    changes; a hub's edges combine before the shuffle. rank: (node, rep).
    """
    two = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    two = cut(two)
    own = rank.select("node", F.struct("rep", "node").alias("label"))
    labels = cut(two.select(F.col("x").alias("node")).distinct().join(own, "node"))
    none = F.lit(None).cast(labels.schema["label"].dataType)
    while True:
        heard = two.join(labels.select(F.col("node").alias("y"), "label"), "y").select(F.col("x").alias("node"), "label", none.alias("old"))
        heard = heard.unionByName(labels.select("node", "label", F.col("label").alias("old")))
        step = heard.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = step.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = cut(step.join(jump, F.col("label.node") == F.col("to"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def relabelled(named: DataFrame, links: DataFrame) -> DataFrame:
    """named(node, label, ...) after links(x, y): classes that links span get the least of their labels. Only the classes' labels
    go through rounds, not their nodes."""
    spans = links.join(named.select(F.col("node").alias("x"), F.col("label").alias("a")), "x").join(named.select(F.col("node").alias("y"), F.col("label").alias("b")), "y").where(F.col("a") != F.col("b"))
    spans = cut(spans.select("a", "b").distinct())
    if spans.isEmpty():
        return named
    rank = spans.select("a.*").unionByName(spans.select("b.*")).distinct()
    top = components(spans.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")), rank)
    return cut(renamed(named, top.select(F.col("node").alias("top"), F.col("label").alias("far"))))


def renamed(named: DataFrame, top: DataFrame) -> DataFrame:
    """named(node, label, ...) with the label far of top(top, far) where top is the label's node."""
    return named.join(top, F.col("label.node") == F.col("top"), "left").withColumn("label", F.coalesce("far", "label")).drop("top", "far")


def prefixes(texts: DataFrame, *, size: int, threshold: float) -> DataFrame:
    """(nid, n, e, left): the elements by which those of texts(node, text) can be found that are as similar as threshold.

    A text's shingles, the k-th occurrence of one being an element of its own, make a set, and the weighted Jaccard similarity is
    that of the sets. Elements are ordered by how many of the texts have them, rarest first. Sets of n and m
    elements with a similarity of t share t / (1 + t) * (n + m) of them at least; so the first element that both have
    comes where that many are left in each, and among the first (1 - t) * n of either. left counts the elements
    from e on that other nodes have too. A text with many elements of its own, such as a copy with too many edits, has no
    such place and is left out before any pair is made. nid is a 64-bit hash of the name.
    """
    most, slack = 1 - threshold, 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1, 1 << 20):
                words, at = _words(batch, 1)
                nid, elements, counts = batch.column(0).to_numpy(), [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own, n = shingles(words[a:b], size)
                    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    elements.append(mix(np.repeat(own, n) + _GOLD * nth.astype(_U)))
                    counts.append(len(nth))
                total = np.repeat(counts, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nid, counts)), pa.array(total, pa.int32()), pa.array(np.concatenate(elements).view(np.int64))], names=["nid", "n", "e"])

    own = texts.select(F.xxhash64("node").alias("nid"), "text").mapInArrow(run, "nid long, n int, e long")
    held = own.groupBy("e").agg(F.count("*").alias("df")).where(F.col("df") > 1).select(F.col("e").bitwiseXOR(F.lit(1)).alias("other"), "df")
    # xor, so that neither side of the join is dealt out by the key already and hot elements can be split
    shared = own.withColumn("other", F.col("e").bitwiseXOR(F.lit(1))).join(held, "other").select("nid", "n", "e", "df")
    whole = Window.partitionBy("nid")
    placed = shared.withColumns({"at": F.row_number().over(whole.orderBy("df", "e")), "m": F.count("*").over(whole)})
    placed = placed.withColumn("left", (F.col("m") - F.col("at") + 1).cast("int"))
    return placed.where(F.col("n") - F.col("left") <= most * F.col("n") + slack).select("nid", "n", "e", "left")


def candidates(early: DataFrame, named: DataFrame, *, threshold: float, one: bool) -> DataFrame:
    """(p, q): pairs of early (prefixes()) whose labels in named(node, label) differ and whose similarity can be threshold or more.

    With one, a partner for each node, so no more pairs than nodes: of each element the class with the most nodes, or for its own nodes the
    class with the fewest, offers the node with the most room, and of a node's offers the one made by most elements counts.
    Else all such pairs, by a join of the elements that several classes have.
    """
    share, slack = threshold / (1 + threshold), 1e-6
    labs = named.select(F.xxhash64("node").alias("nid"), F.xxhash64("label").alias("lab"))
    rows = early.join(labs, "nid").withColumn("room", F.col("left") - share * F.col("n") + slack)
    best = rows.groupBy("e", "lab").agg(F.count("*").alias("k"), F.max(F.struct("room", "nid", "n")).alias("best"), F.min("n").alias("least"))
    ends = F.struct("k", "lab", "best")
    top = best.groupBy("e").agg(F.max(ends).alias("hi"), F.min(ends).alias("lo"), F.min("least").alias("least")).where(F.col("hi.lab") != F.col("lo.lab"))
    top = top.select(F.col("e").bitwiseXOR(F.lit(1)).alias("other"), "hi", "lo", "least")
    able = rows.withColumn("other", F.col("e").bitwiseXOR(F.lit(1))).join(top, "other").where(F.col("room") >= share * F.col("least"))
    if one:
        offer = able.select("nid", "n", "room", F.when(F.col("lab") != F.col("hi.lab"), F.col("hi.best")).otherwise(F.col("lo.best")).alias("to"))
        offer = offer.where((F.col("room") >= share * F.col("to.n")) & (F.col("to.room") >= share * F.col("n")))
        made = offer.groupBy(F.col("nid").alias("p"), F.col("to.nid").alias("q")).agg(F.count("*").alias("k"))
        return made.groupBy("p").agg(F.max(F.struct("k", "q")).alias("to")).select("p", F.col("to.q").alias("q"))
    able = cut(able.select("nid", "n", "e", "lab", "room"))
    a, b = able.alias("a"), able.alias("b")
    on = (F.col("a.e") == F.col("b.e")) & (F.col("a.nid") < F.col("b.nid")) & (F.col("a.lab") != F.col("b.lab")) & (F.col("a.room") >= share * F.col("b.n")) & (F.col("b.room") >= share * F.col("a.n"))
    return a.join(b, on).select(F.col("a.nid").alias("p"), F.col("b.nid").alias("q")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, size: int = 5, bands: int = 20, rows: int = 4) -> DataFrame:
    """(id_col, class_id, n_in_class): a row for each row of docs, classes being the connected parts of the
    links between texts whose `size`-word shingles have a weighted Jaccard similarity of at least threshold.

    Words are folded (word_hashes); texts of equal words are one node, so exact copies never meet as
    pairs. Signatures of bands x rows coordinates: a pair at 0.8 shares no band with a
    probability of 3e-5. In each bucket all nodes are checked against one, its leader, and linked where
    the similarity holds. Links within a class add nothing, so only nodes of buckets that then span classes go on:
    of them, pairs of different classes are checked that their rarest shingles do not rule out (prefixes, candidates): ROUNDS
    times one for each text, then all whose texts are still in different classes. So no link that shares a bucket is lost, and a
    bucket of near copies costs as many checks as it has nodes.

    class_id is the least id of the class; null ids come last. A text without words (null, empty,
    marks only) is a class of its own, of its own id. n_in_class counts rows. Rows of equal id and text
    are rows of one class. Other columns don't matter.
    """
    signed = cut(signatures(docs, id_col, text_col, bands=bands, rows=rows, size=size))
    some = signed.where(F.col("node").isNotNull())
    nodes = some.groupBy("node").agg(F.coalesce(F.min("id"), F.lit(_LAST)).alias("rep"), F.first("bands").alias("bands"))
    nodes = cut(nodes)
    rank = nodes.select("node", "rep")
    # xor, so that neither side of the join is dealt out by the key already and hot buckets can be split
    member = nodes.select("node", "rep", F.explode("bands").alias("band")).withColumn("bucket", F.col("band").bitwiseXOR(F.lit(1)))
    leaders = member.groupBy("band").agg(F.min(F.struct("rep", "node")).alias("leader"), F.count("*").alias("n")).where(F.col("n") > 1)
    leaders = leaders.select(F.col("band").bitwiseXOR(F.lit(1)).alias("bucket"), F.col("leader.node").alias("leader"))
    shared = cut(member.drop("band").join(leaders, "bucket"))
    stars = cut(shared.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("x"), F.col("node").alias("y")).distinct())

    ends = stars.select(F.col("x").alias("node")).unionByName(stars.select(F.col("y").alias("node"))).distinct().join(rank, "node")
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    texts = cut(named_texts(texts.join(ends.select(F.col("rep").alias("id")).where(F.col("id") != _LAST).distinct(), "id", "left_semi").unionByName(texts.where(F.col("id").isNull())))
                .join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    tested = cut(similarities(stars, texts, size=size))
    linked = tested.where(F.col("sim") >= threshold)
    labels = components(linked, rank)
    named = cut(rank.join(labels, "node", "left").select("node", F.coalesce("label", F.struct("rep", "node")).alias("label")))

    placed = shared.select("bucket", "node").join(named, "node")
    torn = placed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where((F.col("a") != F.col("b")) & (F.col("n") > 2)).select("bucket")
    rest = cut(placed.join(torn, "bucket", "left_semi").select("node", "label").distinct())
    if not rest.isEmpty():
        few = cut(texts.join(rest.select("node"), "node", "left_semi"))
        early = cut(prefixes(few, size=size, threshold=threshold))
        core = rest.withColumn("was", F.col("label"))
        for one in (True,) * ROUNDS + (False,):
            pairs = cut(candidates(early, core, threshold=threshold, one=one))
            links = cut(similarities(pairs, few, size=size).where(F.col("sim") >= threshold))
            if not links.isEmpty():
                core = relabelled(core, links)
        merged = core.where(F.col("was") != F.col("label")).select(F.col("was.node").alias("top"), F.col("label").alias("far")).distinct()
        named = cut(renamed(named, merged))

    classes = named.select("node", F.col("label.rep").alias("rep"), F.col("label.node").alias("root"))
    classed = some.select("id", "node").join(classes, "node")
    h1, h2 = key2(F.col("root"))
    classed = classed.withColumns({"h1": h1, "h2": h2})
    counts = classed.groupBy("h1", "h2").agg(F.count("*").alias("n_in_class"))
    classed = join_hashed(classed, counts, "h1", "h2").select("id", F.when(F.col("rep") != _LAST, F.col("rep")).alias("class_id"), "n_in_class", (F.col("id") == F.col("rep")).alias("first"))
    alone = signed.where(F.col("node").isNull()).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_in_class"), F.lit(True).alias("first"))
    return classed.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "n_in_class")


def named_texts(texts: DataFrame) -> DataFrame:
    """texts(id, text) as (node, text), without those that have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                words, at = _words(batch, 1)
                names = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(1)], names=["node", "text"])

    return texts.mapInArrow(run, "node binary, text string").where(F.col("node").isNotNull())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
