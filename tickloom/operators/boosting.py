"""Boosted regression trees from histograms: second-order trees grown by level, trees grown leaf by leaf, and symmetric trees with ordered residuals.

Features are cut into bins once. For each step of a tree, tasks add up residuals and rows by (node, feature, bin), the sums are added before and after
the shuffle, and the driver holds what the model's size bounds: at most leaves x features x bins sums, whatever the rows are. Only the smaller of two
children is asked for; its sibling is what its parent leaves. Residuals are rounded to multiples of a power of two that lets any sum of them
be exact, so trees don't depend on how rows are partitioned. Thousands of steps of few rows would be all scheduling: up to NEAR numbers, the same steps
are taken in one task, with the same trees.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Trees whose predictions each job works out anew before they are kept.
REWRITE = 10
#: So many tasks' sums are added without a shuffle.
FEW = 8
#: Bins and predictions, at most, of a table whose trees are grown in one task: a tenth of a GB with all that is made of them there.
NEAR = 1 << 22


@dataclass(frozen=True)
class Growth:
    """How an ensemble grows. `penalty` is the L2 penalty of a leaf's value, `least` the rows a leaf needs, `gain` what a split must exceed; `first` is the
    first tree's rate, where that is another."""

    trees: int = 200
    rate: float = 0.05
    depth: int | None = None
    leaves: int | None = None
    penalty: float = 0.0
    least: int = 1
    symmetric: bool = False
    bins: int = 255
    gain: float = 0.0
    first: float | None = None


class Tree(NamedTuple):
    """Node k sends a row left if its bin of feature[k] is at most cut[k]; a leaf's feature is -1. values[k] has a number for each model."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray

    def places(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := self.feature[at] >= 0).any():
            f = np.where(inner, self.feature[at], 0)
            at = np.where(inner, np.where(bins[rows, f] <= self.cut[at], self.left[at], self.right[at]), at)
        return at


class Symmetric(NamedTuple):
    """All nodes of level k ask feature[k] and cut[k]: a leaf's number has the answers as its bits, the first one as its lowest."""

    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray

    def places(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for k, (f, c) in enumerate(zip(self.feature, self.cut, strict=True)):
            at |= (bins[:, f] > c).astype(np.int64) << k
        return at


class Ensemble(NamedTuple):
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree | Symmetric]


def edges_of(rows: DataFrame, columns: list[str], bins: int = 255, off: float = 0.25) -> list[np.ndarray]:
    """At most `bins` distinct edges of each column: quantiles, off by at most `off` bins in rank. With 0 they don't depend on partitions either. A value's bin is the number of edges below it."""
    share = [k / (bins + 1) for k in range(1, bins + 1)]
    found = rows.approxQuantile(columns, share, off / (bins + 1))
    return [np.unique(np.asarray(q, float)) for q in found]


def binned(rows: DataFrame, columns: list[str], edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """`keep` and the bins of the columns, a byte each. Null and NaN are below all edges."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, len(edges)), np.uint8)
            for k, cut in enumerate(edges):
                x = batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(float)
                found[:, k] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _packed(found)], names=[*keep, "bins"])

    return rows.select(*keep, *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns))).mapInArrow(run, f"{kind}, bins binary")


def _packed(x: np.ndarray) -> pa.Array:
    """Each row of x as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """What _packed made of rows of `width` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Block(NamedTuple):
    """Rows of a batch: their bins, targets, turns, and predictions of all models so far."""

    bins: np.ndarray
    target: np.ndarray
    turn: np.ndarray
    at: np.ndarray

    def after(self, trees: list) -> np.ndarray:
        return sum((t.values[t.places(self.bins)] for t in trees), self.at)


def blocks(state: DataFrame, width: int, models: int, base: float) -> RDD:
    """The rows of state(target, turn, bins), a Block for each batch. Fits run thousands of jobs of one step each over these, for which planning a
    query each time would cost more than the step: hence no DataFrame. What is lost with an executor is read again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = [batch.column(0).to_numpy().tobytes(), batch.column(1).to_numpy().tobytes(), b"".join(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in whole], names=["target", "turn", "bins"])

    def block(row: Row) -> Block:
        target = np.frombuffer(row.target)
        return Block(np.frombuffer(row.bins, np.uint8).reshape(len(target), width), target, np.frombuffer(row.turn, np.int32), np.full((len(target), models), base))

    return state.select("target", "turn", "bins").mapInArrow(pack, "target binary, turn binary, bins binary").rdd.map(block)


def near_blocks(batches: Iterator[pa.RecordBatch], width: int, models: int, base: float) -> list[Block]:
    """The Blocks of batches of (target, turn, bins)."""
    some = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _unpacked(b.column(2), width, np.uint8)) for b in batches if b.num_rows]
    return [Block(bins, target, turn, np.full((len(target), models), base)) for target, turn, bins in some]


class _Asker:
    """Histograms of rows by node: residuals and counts as (nodes, 2, features, bins), residuals as multiples of `unit`."""

    def __init__(self, rows: RDD, features: int, models: int, bins: int, unit: float):
        self.start = self.rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.features, self.models, self.bins, self.unit, self.trees, self.kept = features, models, bins, unit, [], []

    def grown(self, tree: Tree | Symmetric) -> None:
        """Later jobs see the tree's predictions. They are worked out anew in each job until there are REWRITE such trees."""
        self.trees.append(tree)
        if len(self.trees) == REWRITE:
            self.kept, self.trees, before = [*self.kept, *self.trees], [], self.rows
            whole = self.kept
            self.rows = self.start.map(lambda b: b._replace(at=b.after(whole))).persist(StorageLevel.MEMORY_AND_DISK)
            self.rows.foreachPartition(lambda it: [None for _ in it])
            if before is not self.start:
                before.unpersist()

    def close(self) -> None:
        self.rows.unpersist()
        self.start.unpersist()

    def summed(self, each: Callable[[Block], Iterator[tuple[int, np.ndarray]]], slots: int, width: int) -> np.ndarray:
        """slots x width sums of what `each` gives of a block, (slot, numbers): added in each task, then by slot. The sums of a few tasks spare the
        shuffle and are added here."""

        def run(some: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
            total: dict[int, np.ndarray] = {}
            for block in some:
                for slot, x in each(block):
                    total[slot] = total[slot] + x if slot in total else x
            return iter(total.items())

        out = np.zeros((slots, width))
        for slot, x in self.gathered(run):
            out[slot] += x
        return out

    def gathered(self, run: Callable) -> list[tuple[int, np.ndarray]]:
        found = self.rows.mapPartitions(run)
        return (found if self.rows.getNumPartitions() <= FEW else found.reduceByKey(np.add)).collect()

    def __call__(self, tree: Tree | Symmetric, nodes: list[int]) -> np.ndarray:
        features, bins, unit, trees = self.features, self.bins, self.unit, list(self.trees)
        slots = np.full(max(len(tree.feature) if isinstance(tree, Tree) else 1 << len(tree.feature), 1), -1)
        slots[nodes] = np.arange(len(nodes))

        def each(b: Block) -> Iterator[tuple[int, np.ndarray]]:
            left = np.rint((b.target - b.after(trees)[np.arange(len(b.target)), b.turn]) / unit)
            slot = slots[tree.places(b.bins)]
            own = slot >= 0
            cell = ((slot[own, None] * features + np.arange(features)) * bins + b.bins[own]).ravel()
            size = (len(nodes), features * bins)
            sums = np.bincount(cell, np.repeat(left[own], features), size[0] * size[1]).reshape(size)
            counts = np.bincount(cell, minlength=size[0] * size[1]).reshape(size)
            for k in np.unique(slot[own]):
                yield int(k), np.concatenate([sums[k], counts[k]])

        return self.summed(each, len(nodes), 2 * features * bins).reshape(-1, 2, features, bins)

    def leaves(self, tree: Symmetric) -> np.ndarray:
        """Sums and counts by (leaf, model) of the rows that the model is fitted on: those whose turn is before the model's own number."""
        models, unit, trees, n = self.models, self.unit, list(self.trees), 1 << len(tree.feature)

        def each(b: Block) -> Iterator[tuple[int, np.ndarray]]:
            seen = b.turn[:, None] < np.arange(models)
            cell = (tree.places(b.bins)[:, None] * models + np.arange(models))[seen]
            left = np.rint((b.target[:, None] - b.after(trees)) / unit)[seen]
            yield 0, np.concatenate([np.bincount(cell, left, n * models), np.bincount(cell, minlength=n * models).astype(float)])

        return self.summed(each, 1, 2 * n * models).reshape(2, n, models)


class _NearAsker(_Asker):
    """The same of blocks at hand, inside a task."""

    def __init__(self, rows: list[Block], features: int, models: int, bins: int, unit: float):
        self.rows, self.features, self.models, self.bins, self.unit, self.trees = rows, features, models, bins, unit, []

    def grown(self, tree: Tree | Symmetric) -> None:
        self.rows = [b._replace(at=b.after([tree])) for b in self.rows]

    def close(self) -> None:
        self.rows = []

    def gathered(self, run: Callable) -> list[tuple[int, np.ndarray]]:
        return list(run(iter(self.rows)))


def _halves(hist: np.ndarray, penalty: float, least: int) -> np.ndarray:
    """Scores of a node's two sides by (feature, cut): squared residual sums over rows and penalty; -inf where a side has under `least` rows."""
    sums = hist.cumsum(axis=2)
    whole, g, c = sums[:, :1, -1:], sums[0, :, :-1], sums[1, :, :-1]
    rest, more = whole[0] - g, whole[1] - c
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(c > 0, g * g / (c + penalty), 0.0) + np.where(more > 0, rest * rest / (more + penalty), 0.0)
    return np.where((c >= least) & (more >= least), score, -np.inf)


def grow(ask: Callable, g: Growth, unit: float) -> Tree:
    """A tree whose leaf with the greatest gain is split next, to at most g.leaves leaves and g.depth levels.

    What would be split next if children had no gain of their own is opened ahead, together, in one job: a tree costs as many jobs as it has levels
    rather than leaves. Openings that turn out not to be needed are not in the tree. Without a limit of leaves this is growth by level.
    """
    limit = g.leaves or 1 << (g.depth or 0)
    feature, cut, left, right, depth, total, hist, best = [-1], [0], [0], [0], [0], [None], [None], [None]

    def routed() -> Tree:
        return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.zeros((len(feature), 1)))

    def judge(n: int) -> None:
        """The node's own best split: (gain, feature, cut), or None."""
        scores = _halves(hist[n], g.penalty, g.least)
        k = int(np.argmax(scores)) if scores.size else 0
        own = total[n][0] ** 2 / (total[n][1] + g.penalty)
        gain = float(scores.flat[k] - own) if scores.size else -np.inf
        best[n] = (gain, *divmod(k, scores.shape[1])) if gain * unit**2 > g.gain and gain > 1e-10 * (own + 1) else None

    def opened(some: list[int], last: bool) -> None:
        """Gives nodes children, with histograms where these may be split again: not in the last step."""
        asked = []
        for n in some:
            _, f, c = best[n]
            feature[n], cut[n], left[n], right[n] = f, c, len(feature), len(feature) + 1
            sides = hist[n][:, f, : c + 1].sum(axis=1)
            for side in (sides, total[n] - sides):
                for column, value in ((feature, -1), (cut, 0), (left, 0), (right, 0), (depth, depth[n] + 1), (total, side), (hist, None), (best, None)):
                    column.append(value)
            if not last and (g.depth is None or depth[n] + 1 < g.depth):
                asked.append((n, *sorted((left[n], right[n]), key=lambda k: total[k][1])))
        found = ask(routed(), [small for _, small, _ in asked]) if asked else []
        for (n, small, large), h in zip(asked, found, strict=True):
            hist[small], hist[large] = h, hist[n] - h
            judge(small)
            judge(large)
        for n in some:
            hist[n] = None

    hist[0] = ask(routed(), [0])[0]
    total[0] = hist[0][:, 0].sum(axis=1)
    judge(0)
    leaves, split, heap = 1, set(), [(-best[0][0], 0)] if best[0] else []
    while heap and leaves < limit:
        if feature[heap[0][1]] < 0:
            shut, seen = [], [n for _, n in heap]
            while seen:
                n = seen.pop()
                if feature[n] < 0:
                    shut.append(n)
                else:
                    seen += [c for c in (left[n], right[n]) if best[c]]
            opened(heapq.nsmallest(limit - leaves, shut, key=lambda n: (-best[n][0], n)), limit - leaves == 1)
        n = heapq.heappop(heap)[1]
        split.add(n)
        leaves += 1
        for child in (left[n], right[n]):
            if best[child]:
                heapq.heappush(heap, (-best[child][0], child))
    inner = np.array([n in split for n in range(len(feature))])
    values = np.array([g.rate * unit * t[0] / (t[1] + g.penalty) if t[1] else 0.0 for t in total])
    return Tree(np.where(inner, feature, -1), np.array(cut), np.array(left), np.array(right), values[:, None])


def grow_symmetric(ask: Callable, g: Growth, unit: float, models: int) -> Symmetric:
    """A tree with one question a level, the one of the greatest sum of scores over all nodes of the level. Each model has leaf values of its own rows."""
    features, cuts = [], []
    asked = Symmetric(np.array([], int), np.array([], int), np.zeros((1, models)))
    hist = ask(asked, [0])
    for level in range(g.depth):
        scores = sum(_halves(h, g.penalty, 0) for h in hist)
        if not scores.size:
            break
        f, c = divmod(int(np.argmax(scores)), scores.shape[1])
        features.append(f)
        cuts.append(c)
        asked = Symmetric(np.array(features), np.array(cuts), np.zeros((2 << level, models)))
        if level + 1 == g.depth:
            break
        low = hist[:, 1, f, : c + 1].sum(axis=1) * 2 <= hist[:, 1, f].sum(axis=1)
        found = ask(asked, [k if s else k + (1 << level) for k, s in enumerate(low)])
        small = low[:, None, None, None]
        hist = np.concatenate([np.where(small, found, hist - found), np.where(small, hist - found, found)])
    sums, counts = ask.leaves(asked)
    return asked._replace(values=g.rate * unit * sums / np.maximum(counts + g.penalty, 1e-300))


def grown_by(ask: _Asker, g: Growth, unit: float, models: int) -> list[Tree | Symmetric]:
    """The ensemble's trees, one after another."""
    trees: list[Tree | Symmetric] = []
    try:
        for k in range(g.trees):
            own = g if k or g.first is None else replace(g, rate=g.first)
            trees.append(grow_symmetric(ask, own, unit, models) if g.symmetric else grow(ask, own, unit))
            ask.grown(trees[-1])
    finally:
        ask.close()
    return trees


def fit(rows: DataFrame, columns: list[str], g: Growth, target: str = "target", seed: int = 42) -> Ensemble:
    """The ensemble of squared errors on rows; rows of a null or NaN target are left out. ValueError if none is left.

    A symmetric ensemble's residuals are ordered (Prokhorenkova et al. 2018): rows have a random turn, models are fitted on the first 1/n, 2/n, 4/n ... of
    the rows, and a row's residual is that of the largest model fitted on rows before it alone; the last model, of all rows, predicts. Turns are
    hashes of a row's bins and target, so equal rows share theirs. Models start from the mean target of all rows.
    """
    y = F.col(target).cast("double")
    sure = kept(rows.where(y.isNotNull() & ~F.isnan(y)).select(*columns, y.alias("_y")), "train")
    n, low, high = sure.agg(F.count("*"), F.min("_y"), F.max("_y")).first()
    if not n:
        raise ValueError("no train rows")
    edges = edges_of(sure, columns, g.bins, 0.0 if n * len(columns) <= NEAR else 0.25)
    bins = max((len(e) for e in edges), default=0) + 1
    models = math.ceil(math.log2(n)) + 2 if g.symmetric else 1
    # a residual stays within twice the targets' range; sums of n of them then are whole numbers below 2^53
    unit = 2.0 ** math.ceil(math.log2(max(2.0 * (high - low), abs(low) * 2.0**-20, 1e-200)) + math.log2(n) - 52)
    base = low + unit * sure.agg(F.sum(F.rint((F.col("_y") - low) / unit).cast("long"))).first()[0] / n
    made = binned(sure, columns, edges, ["_y"])
    turn = F.lit(0)
    if g.symmetric:
        # model k, of the first 2^(k + 1 - models) of the rows, has those with a turn below k
        share = (F.xxhash64("bins", "_y", F.lit(seed)).bitwiseAND((1 << 52) - 1) + 1) / float(1 << 52)
        turn = F.greatest(F.ceil(F.log2(share)) + models - 2, F.lit(0))
    state = kept(made.select(F.col("_y").alias("target"), turn.cast("int").alias("turn"), "bins"), "boosting")
    width = len(columns)
    if n * (width + models) > NEAR:
        trees = grown_by(_Asker(blocks(state, width, models, base), width, models, bins, unit), g, unit, models)
    else:

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = grown_by(_NearAsker(near_blocks(batches, width, models, base), width, models, bins, unit), g, unit, models)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["trees"])

        trees = pickle.loads(state.coalesce(1).mapInArrow(near, "trees binary").first().trees)
    return Ensemble(columns, edges, base, [t._replace(values=t.values[:, -1:]) for t in trees])


def predict(rows: DataFrame, e: Ensemble, keep: list[str]) -> DataFrame:
    """`keep` of all rows, and prediction."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = _unpacked(batch.column(len(keep)), len(e.columns), np.uint8)
                at = np.full(len(bins), e.base)
                for t in e.trees:
                    at += t.values[t.places(bins), 0]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at)], names=[*keep, "prediction"])

    return binned(rows, e.columns, e.edges, keep).mapInArrow(run, f"{kind}, prediction double")
