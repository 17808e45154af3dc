"""N-gram Jaccard join: sets of shingles against groups of similar sets, by a matrix of tokens and groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, quoted, read_table, stored
from .near_dup import relabelled, renamed
from .word_hashes import buffer_of, fold_ascii, gram_hashes, turns, word_hashes

_U = np.uint64
_LAST = (1 << 63) - 1
#: One token in so many is looked at beyond those that a link needs; results don't depend on it.
SPARE = 20
#: How many times a set of an opened group tries one partner before all pairs still apart are made; nor on this.
ROUNDS = 1
#: How many sets may meet at a token as pairs; where more do, their differences from one of them meet instead; nor on this.
MANY = 16
#: How many times a set tries the partner that its differences speak for most, before all pairs left are made; nor on this.
TRIES = 2


def least_common(n, percent: int):
    """How many tokens a set of n shares at least with any set that it links with; also the least size of such a set. For numbers, arrays and columns."""
    return _whole((percent * n + 99) / 100) if isinstance(n, Column) else (percent * n + 99) // 100


def spare(n):
    """How many tokens two linked sets share at least among their first tokens, n being the smaller set's size."""
    return _whole((n + SPARE - 1) / SPARE) if isinstance(n, Column) else (n + SPARE - 1) // SPARE


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def _sets(texts: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct shingles in ascending order of each text that has words, which texts these are)."""
    raw, at = buffer_of(texts)
    low = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(fold_ascii(raw)))
    words, bounds = word_hashes(low)
    some = np.flatnonzero(np.diff(bounds))
    return [np.unique(gram_hashes(words[bounds[i] : bounds[i + 1]], min(size, int(bounds[i + 1] - bounds[i])))) for i in some], some


def _name(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def token_sets(docs: DataFrame, id_col: str, text_col: str, *, size: int, percent: int) -> DataFrame:
    """(id, node, n, early) of each row: n tokens, a 128-bit name of their set, and the first of them in the order of their hashes.

    Two sets that link share `a` tokens, at least the share `percent` of either's. The i-th of those has at most n - a + i tokens
    up to it in a set of n, so the first spare(the smaller n) of them are among the first n - least_common(n) + spare(n) of both.
    A text without words has a null node and n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1, 2 << 20):
                made, some = _sets(batch.column(1), size)
                n = np.zeros(batch.num_rows, np.int64)
                n[some] = [len(x) for x in made]
                first = n - least_common(n, percent) + spare(n)
                nodes: list[bytes | None] = [None] * batch.num_rows
                for i, x in zip(some.tolist(), made, strict=True):
                    nodes[i] = _name(x)
                ends = np.zeros(batch.num_rows + 1, np.int32)
                np.cumsum(first, out=ends[1:])
                early = np.concatenate([np.zeros(0, _U), *(x[: first[i]] for i, x in zip(some.tolist(), made, strict=True))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(early.view(np.int64)))], names=["id", "node", "n", "early"])

    return docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).mapInArrow(run, "id long, node binary, n long, early array<long>")


def set_texts(texts: DataFrame, size: int) -> DataFrame:
    """texts(id, text) as (node, text), without those that have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1):
                made, some = _sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in made], pa.binary()), batch.column(1).take(pa.array(some))], names=["node", "text"])

    return texts.mapInArrow(run, "node binary, text string")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, text_x, text_y) of pairs(x, y), or pairs(p, q) of the 64-bit hashes of names."""
    ends, key = (("x", "y"), F.col("node")) if "x" in pairs.columns else (("p", "q"), F.xxhash64("node"))
    at_x, at_y = (texts.select(key.alias(end), F.struct("node", "text").alias(f"end_{end}")) for end in ends)
    both = pairs.select(*ends).join(at_y, ends[1]).join(at_x, ends[0]).select(*(F.col(f"end_{end}.{c}").alias(f"{c}_{k}") for c in ("node", "text") for end, k in zip(ends, "xy", strict=True)))
    return both.select(F.col("node_x").alias("x"), F.col("node_y").alias("y"), "text_x", "text_y")


def linked(pairs: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """(x, y): those of pairs(x, y), or pairs(p, q) of the 64-bit hashes of names, that link: 100 * tokens in common >= percent * tokens in
    either, of texts(node, text)."""
    both = with_texts(pairs, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2, 2 << 20):
                # a text stands in many pairs: each is cut into shingles once
                (left, right), keep = (batch.column(k).dictionary_encode() for k in (2, 3)), []
                a, b = (_sets(x.dictionary, size)[0] for x in (left, right))
                for i, (p, q) in enumerate(zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True)):
                    common = len(np.intersect1d(a[p], b[q], assume_unique=True))
                    if 100 * common >= percent * (len(a[p]) + len(b[q]) - common):
                        keep.append(i)
                yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "x binary, y binary")


def survivors(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, rep, n, token, df) of nodes(node, rep, n, early): the first tokens that other sets have too, of the sets that can link at all; df sets have a token.

    All other sets are one group here: a set of whose first tokens fewer are in that group's union than a link needs is out,
    before any pair is made. Only hashes are shuffled; a frequent token's rows can be split.
    """
    own = nodes.select(F.xxhash64("node").alias("nid"), F.explode("early").alias("token"))
    # xor, so that neither side of the join is dealt out by the key already and hot tokens can be split
    twice = own.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1).select(F.col("token").bitwiseXOR(F.lit(1)).alias("other"), "df")
    shared = stored(own.withColumn("other", F.col("token").bitwiseXOR(F.lit(1))).join(twice, "other").select("nid", "token", "df"), "shared")
    named = nodes.select("node", "rep", "n", F.xxhash64("node").alias("nid"))
    able = shared.groupBy("nid").agg(F.count("*").alias("k")).join(named, "nid").where(F.col("k") >= spare(least_common(F.col("n"), percent))).drop("k")
    return stored(shared.join(able, "nid").select("node", "rep", "n", "token", "df"), "survivors")


def qualifying(rows: DataFrame, percent: int) -> DataFrame:
    """(node, g): the groups in which each set may have a link to a set of a class of higher rank.

    rows: (node, n, g, rank, token), rank telling classes apart. The matrix has a cell for each token and group that holds it in the
    union of its sets' first tokens, with the highest class and the sizes of the sets that have it. A set's overlap with
    a group's union, over cells that leave such a link possible, bounds its overlap with every set of the group; the
    group qualifies if the bound reaches what a link needs. Of two classes the lower one asks, so a large class of near copies doesn't.
    """
    n, own = F.col("n"), F.col("rank")
    asked = rows.select("node", "n", "rank", F.col("token").bitwiseXOR(F.lit(1)).alias("other"))
    matrix = rows.groupBy("token", "g").agg(F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = matrix.select(F.col("token").bitwiseXOR(F.lit(1)).alias("other"), "g", "top", "low", "high")
    cells = asked.join(matrix, "other").where((own < F.col("top")) & (F.col("high") >= least_common(n, percent)) & (n >= least_common(F.col("low"), percent)))
    bound = cells.groupBy("node", "g").agg(F.count("*").alias("overlap"), F.first("n").alias("n"))
    return bound.where(F.col("overlap") >= spare(least_common(n, percent))).select("node", "g")


def rarest(texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """(nid, n, m, e, left) of texts(node, text): the rarest tokens of each set, as many as a link allows to be missing, and how many tokens that
    other sets have too are left from each on, of m in all. nid is a 64-bit hash of the name.

    Two sets of n and m tokens that link share p / (100 + p) of n + m, p being percent; in one order of all tokens, rarest first, the first one that both have
    comes where that many are left in each. A set with too many tokens of its own has no such place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 1, 1 << 20):
                made, some = _sets(batch.column(1), size)
                n = np.array([len(x) for x in made], np.int64)
                tokens = np.concatenate([np.zeros(0, _U), *made]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy()[some], n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(tokens)], names=["nid", "n", "e"])

    own = texts.select(F.xxhash64("node").alias("nid"), "text").mapInArrow(run, "nid long, n int, e long")
    other = F.col("e").bitwiseXOR(F.lit(1)).alias("other")
    held = own.groupBy("e").agg(F.count("*").alias("df")).where(F.col("df") > 1).select(other, "df")
    shared = own.select("*", other).join(held, "other").select("nid", "n", "e", "df")
    whole = Window.partitionBy("nid")
    placed = shared.withColumns({"at": F.row_number().over(whole.orderBy("df", "e")), "m": F.count("*").over(whole)})
    placed = placed.withColumn("left", (F.col("m") - F.col("at") + 1).cast("int"))
    return placed.where(F.col("left") >= least_common(F.col("n"), percent)).select("nid", "n", "m", "e", "left")


def flipped(name: str) -> Column:
    """A key with a bit turned: neither side of a join on it is dealt out by it already, so hot keys can be split."""
    return F.col(name).bitwiseXOR(F.lit(1)).alias("other")


def contested(rows: DataFrame) -> DataFrame:
    """rows(nid, lab, e, room, ask, ...) of tokens e that several classes have and of sets that can meet another one there; hi and lo are
    the class with the most and the one with the fewest sets, and the set with the most room of each.

    Two sets of different classes may link if they have a token at which the room of either is at least what the other asks for.
    """
    best = rows.groupBy("e", "lab").agg(F.count("*").alias("k"), F.max(F.struct("room", "nid", "ask")).alias("best"), F.min("ask").alias("least"))
    ends = F.struct("k", "lab", "best")
    top = best.groupBy("e").agg(F.max(ends).alias("hi"), F.min(ends).alias("lo"), F.min("least").alias("least"), F.max("best.room").alias("most")).where(F.col("hi.lab") != F.col("lo.lab"))
    able = rows.withColumn("other", flipped("e")).join(top.select(flipped("e"), "hi", "lo", "least", "most"), "other")
    return able.where((F.col("room") >= F.col("least")) & (F.col("most") >= F.col("ask"))).drop("other", "least", "most")


def partners(able: DataFrame) -> DataFrame:
    """(p, q): a partner for each set of contested(), the one that most tokens offer."""
    offer = able.select("nid", "ask", "room", F.when(F.col("lab") != F.col("hi.lab"), F.col("hi.best")).otherwise(F.col("lo.best")).alias("to"))
    offer = offer.where((F.col("room") >= F.col("to.ask")) & (F.col("to.room") >= F.col("ask")))
    made = offer.groupBy(F.col("nid").alias("p"), F.col("to.nid").alias("q")).agg(F.count("*").alias("k"))
    return made.groupBy("p").agg(F.max(F.struct("k", "q")).alias("to")).select("p", F.col("to.q").alias("q"))


def meetings(able: DataFrame) -> DataFrame:
    """(p, q): all pairs of contested() that may link."""
    a, b = able.alias("a"), able.alias("b")
    on = (F.col("a.e") == F.col("b.e")) & (F.col("a.nid") < F.col("b.nid")) & (F.col("a.lab") != F.col("b.lab")) & (F.col("a.room") >= F.col("b.ask")) & (F.col("b.room") >= F.col("a.ask"))
    return a.join(b, on).select(F.col("a.nid").alias("p"), F.col("b.nid").alias("q")).distinct()


def differences(spokes: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """(x, y, cost, near, far, diff) of spokes(p, q): the tokens that only one of a set x and its pivot y has.

    Two sets a and b with differences of d and f from one pivot, x of them in common, differ in d + f - 2 x tokens, and link if
    (100 + percent) * that <= (100 - percent) * (the sum of their sizes). So with cost = (100 + percent) * d - (100 - percent) * size they link if
    2 * (100 + percent) * x >= the sum of their costs. The pivot has no differences and the least cost.

    Jaccard distances obey the triangle inequality: of two sets that link, both are near, at most 1/2 and a link's distance from the
    pivot, or both far, over 1/2. Only what is near has a diff here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in turns(whole, 2, 1 << 20):
                (left, right) = (batch.column(k).dictionary_encode() for k in (2, 3))
                a, b = (_sets(x.dictionary, size)[0] for x in (left, right))
                cost, near, far, diff = [], [], [], []
                for p, q in zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True):
                    d = np.setxor1d(a[p], b[q], assume_unique=True)
                    twice = len(a[p]) + len(b[q]) + len(d)  # the union, twice
                    cost.append((100 + percent) * len(d) - (100 - percent) * len(a[p]))
                    near.append(200 * len(d) <= (150 - percent) * twice)
                    far.append(4 * len(d) > twice)
                    diff.append(d if near[-1] else d[:0])
                ends = np.concatenate([[0], np.cumsum([len(d) for d in diff])]).astype(np.int32)
                tokens = np.concatenate([np.zeros(0, _U), *diff]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cost, pa.int64()), pa.array(near, pa.bool_()), pa.array(far, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))],
                                                 names=["x", "y", "cost", "near", "far", "diff"])

    return with_texts(spokes, texts).mapInArrow(run, "x binary, y binary, cost long, near boolean, far boolean, diff array<long>")


def rarest_differences(measured: DataFrame, percent: int) -> DataFrame:
    """(nid, e, room, ask): the differences in differences() that several sets have from one pivot, as e; room is what the cost of another
    set can be at most, if this is the rarest difference that they share."""
    own = measured.select(F.xxhash64("x").alias("nid"), "y", "cost", F.explode("diff").alias("token")).select("nid", "y", "cost", F.xxhash64("y", "token").alias("e"))
    held = own.groupBy("e").agg(F.count("*").alias("df")).where(F.col("df") > 1).select(flipped("e"), "df")
    shared = own.withColumn("other", flipped("e")).join(held, "other").drop("other")
    left = F.count("*").over(Window.partitionBy("nid", "y").orderBy(F.desc("df"), F.desc("e")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return shared.select("nid", "e", (2 * (100 + percent) * left - F.col("cost")).alias("room"), F.col("cost").alias("ask"))


def open_groups(asks: DataFrame, named: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """named(node, label, g, ...) after the links between the sets of asks(node, g) and the members of their groups.

    Only these sets are opened. Each first tries one partner, ROUNDS times: the one that its rarest tokens speak for most; then all
    pairs still in different classes are checked that their rarest tokens and sizes leave room for, where no more than MANY sets meet at
    a token. At any other token one of its sets is the pivot. All are checked against it; sets that do not link with it can
    only link, with whatever other set, by differences from it that both have, so pairs are made at the rarest of those.
    """
    inside = named.join(asks.select("g").distinct(), "g", "left_semi").select("node").unionByName(asks.select("node")).distinct()
    core = stored(named.join(inside, "node", "left_semi").select("node", "label").withColumn("was", F.col("label")), "opened")
    if core.isEmpty():
        return named
    few = stored(texts.join(core.select("node"), "node", "left_semi"), "few")
    share, slack = percent / (100 + percent), 1e-6
    early = stored(rarest(few, size=size, percent=percent), "rarest")
    early = early.withColumns({"room": F.col("left") - share * F.col("n") + slack, "ask": share * F.col("n")})

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(core.select(F.xxhash64("node").alias("nid"), F.xxhash64("label").alias("lab")), "nid")

    def checked(pairs: DataFrame) -> DataFrame:
        return stored(linked(stored(pairs, "pairs"), few, size=size, percent=percent), "links")

    def joined(links: DataFrame) -> DataFrame:
        # a table, as the optimizer's constraints on a checkpoint double with every relabelling
        return core if links.isEmpty() else stored(relabelled(core, links), "core")

    for _ in range(ROUNDS):
        core = joined(checked(partners(contested(classed(early)))))

    able = stored(contested(classed(early)).select("nid", "lab", "e", "room", "ask", (F.col("m") / F.col("n")).alias("like")), "able")
    # of a crowd's sets the one with the fewest tokens of its own
    crowds = able.groupBy("e").agg(F.count("*").alias("k"), F.max(F.struct("like", "nid"))["nid"].alias("q")).where(F.col("k") > MANY)
    crowds = stored(crowds.select(flipped("e"), "q"), "crowds")
    pairs = meetings(able.join(crowds.select(F.col("other").bitwiseXOR(F.lit(1)).alias("e")), "e", "left_anti"))
    if not crowds.isEmpty():
        crowded = stored(able.withColumn("other", flipped("e")).join(crowds, "other").drop("other", "like"), "crowded")
        measured = stored(differences(crowded.select(F.col("nid").alias("p"), "q").distinct(), few, size=size, percent=percent), "measured")
        # the pivot's cost is -(100 - percent) * its size
        pivots = measured.where(F.col("x") == F.col("y")).select("y", F.col("cost").alias("least"))
        links = measured.join(pivots, "y").where((F.col("cost") + F.col("least") <= 0) & (F.col("x") != F.col("y"))).select("x", "y")
        core = joined(stored(links, "links"))
        far = crowded.drop("lab").join(measured.where("far").select(F.xxhash64("x").alias("nid"), F.xxhash64("y").alias("q")), ["nid", "q"])
        near = stored(rarest_differences(measured.where("near"), percent), "near")
        for _ in range(TRIES):
            links = checked(partners(contested(classed(near))))
            if links.isEmpty():
                break
            core = joined(links)
        pairs = pairs.unionByName(meetings(stored(contested(classed(near)), "apart")))
        if not measured.where("far").isEmpty():
            pairs = pairs.unionByName(meetings(stored(contested(classed(far)), "far")))
        pairs = pairs.distinct()
    core = joined(checked(pairs))
    merged = core.where(F.col("was") != F.col("label")).select(F.col("was.node").alias("top"), F.col("label").alias("far")).distinct()
    return renamed(named, merged)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id): a row for each row of docs, of the links between texts whose sets of
    `size`-word shingles have 100 * intersection >= percent * union.

    A-Z are lower-cased; words are runs of anything but ASCII white space; fewer words than `size` are one shingle. Shingles are
    told apart by 64-bit hashes. Texts of equal sets are one node, so copies never meet as pairs. Nodes that
    can link at all (survivors) are partitioned into groups by the most frequent of their first tokens, which similar sets mostly
    agree on, so that few groups hold a token. First sets that agree on the least of theirs are checked against one of them. Then sets ask the matrix of tokens and groups which groups' unions leave room for
    a link with another class (qualifying), and only those are opened (open_groups). Within a class a link adds nothing, so its sets aren't
    compared. No link between classes is lost, whatever the groups are.

    component_id is the least id that links reach; null ids come last, and a class of null ids only has a null one. A text without words
    (null, empty, white space) has n_shingles 0 and is a component of its own. Rows of equal id and text are rows of one component. Other columns don't matter.
    """
    whole = stored(token_sets(docs, id_col, text_col, size=size, percent=percent), "sets")
    made = stored(whole.select("id", "node", "n"), "ids")
    some = made.where(F.col("node").isNotNull())
    nodes = whole.where(F.col("node").isNotNull()).groupBy("node").agg(F.coalesce(F.min("id"), F.lit(_LAST)).alias("rep"), F.first("n").alias("n"), F.first("early").alias("early"))
    nodes = stored(nodes, "nodes")
    forget(whole)
    rows = survivors(nodes, percent)
    named = stored(rows.groupBy("node").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.max(F.struct("df", "token"))["token"].alias("g"), F.min("token").alias("star"), F.count("*").alias("k")), "named")

    reps = named.select(F.col("rep").alias("id")).where(F.col("id") != _LAST).distinct()
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    texts = set_texts(texts.join(reps, "id", "left_semi").unionByName(texts.where(F.col("id").isNull())), size)
    texts = stored(texts.join(named.select("node"), "node", "left_semi").dropDuplicates(["node"]), "texts")

    # the member with the fewest tokens of its own is most like the others
    central = F.struct(F.col("k") / (F.col("n") - least_common(F.col("n"), percent) + spare(F.col("n"))), "node")
    leaders = named.groupBy("star").agg(F.max(central).alias("leader"), F.count("*").alias("members")).where(F.col("members") > 1).select("star", F.col("leader.node").alias("x"))
    stars = named.join(leaders, "star").where(F.col("node") != F.col("x")).select("x", F.col("node").alias("y"))
    links = stored(linked(stars, texts, size=size, percent=percent), "links")
    # a set is in one star, so a star's links are a class
    ends = stored(links.select("x", F.col("y").alias("node")).unionByName(links.select("x", F.col("x").alias("node"))).distinct().join(named.select("node", "rep"), "node"), "ends")
    labels = ends.join(ends.groupBy("x").agg(F.min(F.struct("rep", "node")).alias("label")), "x").select("node", "label")
    named = stored(named.join(labels, "node", "left").withColumn("label", F.coalesce("label", F.struct("rep", "node"))), "labels")
    sizes = named.groupBy("label").agg(F.count("*").alias("members"))
    ranked = named.join(sizes, "label").select("node", "n", "g", F.struct("members", "label").alias("rank"))
    asks = stored(qualifying(stored(rows.select("node", "token").join(ranked, "node"), "ranked"), percent), "asks")
    named = stored(open_groups(asks, named, texts, size=size, percent=percent), "classes")

    rep = F.coalesce(F.col("label.rep"), F.col("own"))
    known = nodes.select("node", F.col("rep").alias("own")).join(named.select("node", "label"), "node", "left").select("node", rep.alias("rep"))
    out = some.select("id", "node", "n").join(known, "node").select("id", "n", F.when(F.col("rep") != _LAST, F.col("rep")).alias("component_id"))
    out = out.unionByName(made.where(F.col("node").isNull()).select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op11_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 3) AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i FROM w WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON r.other = x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
