"""Benchmark decontamination: CGK embeddings of windows, bit sampling, exact edit distances."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key2, prefix_for, quoted, read_table, scratch
from .word_hashes import mix, turns, word_hashes

_U = np.uint64
#: Bytes of benchmark text that are shipped to the tasks at a time; a larger benchmark is searched in blocks.
BLOCK_BYTES = 1 << 20
#: Coordinates of an embedding that a sample looks at.
SAMPLED = 3
#: Words of a piece: items of more than twice as many are looked for by pieces.
PIECE = 24
#: Edited copies that the recall is measured over, for each class of sizes.
_COPIES = 1500
#: An item's words in at least this share of the items are common.
_COMMON = 0.03


def step_multipliers(walk: int, steps: int) -> np.ndarray:
    """The hash functions of a walk, one for each step, as odd numbers: the highest bit of a word's key times
    the step's number says whether the walk goes on."""
    return mix(np.arange(steps, dtype=_U) + _U(((walk + 1) << 32) % (1 << 64))) | _U(1)


def sampled_steps(walk: int, size: int) -> np.ndarray:
    """The steps of a walk that its sample looks at. A walk goes on at every second step on average, so the
    words of `size` are spent after about 2 * size steps; later coordinates are mostly padding."""
    n = min(SAMPLED, 2 * size)
    order = np.argsort(mix(np.arange(2 * size, dtype=_U) ^ _U(0xC6A4A7935BD1E995 * (walk + 1) % (1 << 64))), kind="stable")
    return np.sort(order[:n])


def sample_keys(keys: np.ndarray, starts: np.ndarray, size: int, walk: int, allowed: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sampled coordinates of the CGK embeddings of the windows keys[start:start + size].

    An embedding writes the word that the walk stands on, then goes on to the next word or stays, as a hash of
    the word and the step says; past the window's end it writes padding (key 0). Returns the windows that
    are left and, for each sampled coordinate, the keys of the samples up to it. With `allowed` (sorted
    keys for each coordinate), windows whose key so far is none of them are left at once.
    """
    steps = sampled_steps(walk, size)
    odd = step_multipliers(walk, int(steps[-1]) + 1)
    alive, at, end = np.arange(len(starts)), starts.copy(), starts + size
    sofar, out, k = np.zeros(len(starts), _U), [], 0
    for j in range(int(steps[-1]) + 1):
        own = keys[np.minimum(at, len(keys) - 1)]
        own = np.where(at < end, own, _U(0))
        if j == steps[k]:
            sofar = mix(sofar * _U(0x9FB21C651E98DF25) + own + _U(1))
            if allowed is not None:
                stay = np.flatnonzero(among(allowed[k], sofar))
                alive, at, end, sofar, own = alive[stay], at[stay], end[stay], sofar[stay], own[stay]
            out.append(sofar)
            k += 1
            if not len(alive):
                return alive, [sofar] * len(steps)
        at = at + ((own * odd[j]) >> _U(63)).astype(np.int64)
    return alive, out


def among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def edit_distances(keys: np.ndarray, starts: np.ndarray, items: np.ndarray, lengths: np.ndarray, slack: int, free: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distance, words) for each pair of a place and an item (a row of `items`, as long as `lengths` says): the
    least edit distance of the item to the words from that place on, and how many words that are. With `free`, to words
    from any of that many places on; then words is where they end."""
    most = int(lengths.max()) + slack + (free or 0)
    places = starts[:, None] + np.arange(most)
    words = np.where(places < len(keys), keys[np.minimum(places, len(keys) - 1)], _U(0))
    column = np.arange(most + 1)
    row = np.tile(column if free is None else np.zeros_like(column), (len(starts), 1)).astype(np.int32)
    final = row.copy()
    for i in range(int(lengths.max())):
        own = items[:, i : i + 1]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ((words != own) | (words == 0)))
        row = np.minimum.accumulate(new - column, axis=1) + column
        done = lengths == i + 1
        final[done] = row[done]
    best = np.argmin(final, axis=1)
    return final[np.arange(len(starts)), best], best


def _pieces(size: int) -> tuple[int, list[int]]:
    """How many words a class's samples are of, and where in an item they start, in the order in which they are used."""
    words = PIECE if size > 2 * PIECE else size
    offsets = np.arange(0, size - words + 1, words)
    return words, offsets[np.argsort(mix(offsets.astype(_U) + _U(1)), kind="stable")].tolist()


@functools.cache
def walks_for(size: int, k: int, target_recall: float) -> int:
    """How many walks make copies of items of `size` words with k random edits meet them with target_recall: walks are
    added until of _COPIES copies, of different words, that share and two standard errors of it more meet by some walk.

    It is measured at the least size and the most edits of the class, which are the hardest. What items a benchmark has
    doesn't matter, so that neither other items nor blocks change what is found.
    """
    rng = np.random.default_rng(size)
    words, offsets = _pieces(size)
    base = mix(np.arange(1, _COPIES * (size + 1) + 1, dtype=_U)) | _U(1)
    flat = base.reshape(_COPIES, size + 1)
    flat[:, size] = 0
    starts = np.arange(_COPIES) * (size + 1)
    copies = [edited(own[:size], k, rng) for own in flat]
    kept = []
    for own, copy in zip(flat, copies, strict=True):
        place = {w: i for i, w in enumerate(own[:size].tolist())}
        hit = [(place[w], i) for i, w in enumerate(copy.tolist()) if w in place]
        kept.append(([a for a, _ in hit], [b for _, b in hit]))
    other, others = Items._flat(_padded(copies), np.zeros(0, np.int64))
    # where in a copy the first word from an offset on stands that it still has
    at = {o: others + [b[min(bisect_left(a, o), len(b) - 1)] if o and b else 0 for a, b in kept] for o in offsets}
    enough = min(1.0, target_recall + 2 * (target_recall * (1 - target_recall) / _COPIES) ** 0.5)
    met, w = np.zeros(_COPIES, bool), 0
    while w < 2 or met.mean() < enough:
        o, left = offsets[w % len(offsets)], np.flatnonzero(~met)
        met[left] = sample_keys(flat.reshape(-1), starts[left] + o, words, w)[1][-1] == sample_keys(other, at[o][left], words, w)[1][-1]
        w += 1
    return w


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(lists), max(map(len, lists), default=1)), _U)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _next(size: int) -> int:
    """The size of the next class of windows: a tenth more."""
    return max(size + 1, size * 11 // 10)


class Items:
    """A block of benchmark items, ready to be looked for: their words' keys, and for each class of sizes the
    keys of their samples. Made on the driver; its size is bounded by that of the block."""

    def __init__(self, ids: list, texts: list[str], max_share: float, target_recall: float, min_words: int = 1):
        hashes, at = word_hashes(pa.array(texts, pa.string()), fold=True)
        hashes = np.maximum(hashes, _U(1))
        lists = [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        some = [i for i, x in enumerate(lists) if len(x) >= min_words]
        self.ids, words = [ids[i] for i in some], [lists[i] for i in some]
        self.lengths = np.array([len(x) for x in words], np.int64)
        self.slack = (self.lengths * max_share).astype(np.int64)
        self.words = np.zeros((len(words), int(self.lengths.max(initial=1))), _U)
        for i, x in enumerate(words):
            self.words[i, : len(x)] = x
        self.vocabulary, held_by = np.unique(np.concatenate([np.unique(x) for x in words]) if words else np.zeros(0, _U), return_counts=True)
        self.rare = self.vocabulary[held_by < max(3, _COMMON * len(words))]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.vocabulary >> _U(44)).astype(np.int64)] = True
        self.classes = []
        sizes = np.array(list(_ladder(int(self.lengths.max(initial=1)))), np.int64)
        own = sizes[np.searchsorted(sizes, self.lengths, "right") - 1] if words else np.zeros(0, np.int64)
        for size in np.unique(own).tolist():
            here = np.flatnonzero(own == size)
            rare = int(np.isin(self.words[here, :size], self.rare).sum(axis=1).min())
            k = int((_next(size) - 1) * max_share)  # of any item of the class, so that other items change nothing
            self.classes.append((size, k, rare - k, here, self._samples(here, size, walks_for(size, k, target_recall))))

    def _samples(self, here: np.ndarray, size: int, walks: int) -> list[tuple[int, int, int, list[np.ndarray], np.ndarray]]:
        """(walk, offset, words) of each sample, the sorted keys of the items' samples up to each coordinate, and the
        items in the last one's order. The words are the item's, or one piece after the other of a long item."""
        flat, starts = self._flat(self.words[here], self.lengths[here])
        words, offsets = _pieces(size)
        out = []
        for w in range(walks):
            o = offsets[w % len(offsets)]
            _, keys = sample_keys(flat, starts + o, words, w)
            order = np.argsort(keys[-1], kind="stable")
            out.append((w, o, words, [np.unique(k) for k in keys[:-1]] + [keys[-1][order]], here[order]))
        return out

    @staticmethod
    def _flat(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.zeros((len(rows), 1), _U)
        whole = np.concatenate([rows, gap], axis=1)
        return whole.reshape(-1), np.arange(len(rows)) * whole.shape[1]

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, words, distance) of every item found, once for each text: its closest, then first place."""
        none = np.zeros(0, np.int64)
        hashes, at = word_hashes(texts, fold=True)
        if not self.classes or not len(hashes):
            return none, none, none, none, none
        gap = max(k for _, k, *_ in self.classes) + 1
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(hashes)) + (owner + 1) * gap
        keys = np.zeros(len(hashes) + (len(n) + 1) * gap, _U)
        known = self.flags[(hashes >> _U(44)).astype(np.int64)]
        hit = np.flatnonzero(known)
        hit = hit[among(self.vocabulary, np.maximum(hashes[hit], _U(1)))]
        # a word that no item has is one symbol: it matches none of theirs, whichever it is
        keys[place] = _U(0xB5297A4D3F84D5B5)
        keys[place[hit]] = np.maximum(hashes[hit], _U(1))
        known, rare = np.zeros((2, len(keys) + 1), np.int32)
        known[place[hit] + 1] = 1
        if len(self.rare):
            rare[place[hit] + 1] = among(self.rare, keys[place[hit]])
        known, rare = np.cumsum(known, dtype=np.int32), np.cumsum(rare, dtype=np.int32)
        found = []
        for size, k, rare_least, here, samples in self.classes:
            # an item within k edits leaves no more than k of the window's words unmatched, and of its own
            stop = len(keys) - size if len(keys) > size else 0
            inside = known[size : size + stop] - known[:stop] >= size - k if stop else np.zeros(0, bool)
            if rare_least > 0 and stop:
                inside &= rare[size : size + stop] - rare[:stop] >= rare_least
            starts = np.flatnonzero(inside)
            last = np.arange(stop, len(keys))  # windows that reach over the end
            if len(last):
                tail = known[len(keys)] - known[last] >= size - k
                starts = np.concatenate([starts, last[tail]])
            pieces = samples[0][2] < size
            if pieces and len(starts):
                # insertions and deletions before a piece move it, by k words at most
                near = np.zeros(len(keys) + 1, np.int32)
                np.add.at(near, np.maximum(starts - k, 0), 1)
                np.add.at(near, np.minimum(starts + k + 1, len(keys)), -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]))
            elif len(starts):
                starts = starts[keys[starts] != 0]
            if not len(starts):
                continue
            pairs = []
            for w, offset, n_words, allowed, ordered in samples:
                at_word = starts + offset
                held = np.flatnonzero((at_word < len(keys)) & (keys[np.minimum(at_word, len(keys) - 1)] != 0))
                if not len(held):
                    continue
                alive, got = sample_keys(keys, at_word[held], n_words, w, allowed)
                alive = held[alive]
                if len(alive):
                    lo, hi = np.searchsorted(allowed[-1], got[-1], "left"), np.searchsorted(allowed[-1], got[-1], "right")
                    count = hi - lo
                    which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                    pairs.append(np.repeat(starts[alive], count) * len(self.ids) + ordered[which])
            if not pairs:
                continue
            both = np.unique(np.concatenate(pairs))
            start, item = both // len(self.ids), both % len(self.ids)
            step, wide = max(1, (1 << 22) // (size + 4 * k)), max(k, 1)
            if pieces:
                both = np.unique(start // wide * len(self.ids) + item)
                start, item = both // len(self.ids) * wide, both % len(self.ids)
            for lo in range(0, len(both), step):
                s, i = start[lo : lo + step], item[lo : lo + step]
                if pieces:
                    # the least distance from any start near the piece's, where that ends, and from there back
                    first = np.maximum(s - wide, 0)
                    far, words = edit_distances(keys, first, self.words[i], self.lengths[i], k, 3 * wide)
                    good = far <= self.slack[i]
                    if not good.any():
                        continue
                    i, end = i[good], (first + words)[good]
                    turned = np.zeros_like(self.words[i])
                    for r, own in enumerate(i.tolist()):
                        turned[r, : self.lengths[own]] = self.words[own, : self.lengths[own]][::-1]
                    far, words = edit_distances(keys[::-1], len(keys) - end, turned, self.lengths[i], k)
                    s = end - words
                else:
                    far, words = edit_distances(keys, s, self.words[i], self.lengths[i], k)
                good = far <= self.slack[i]
                found.append(np.stack([s[good], i[good], words[good], far[good]]))
        if not found:
            return none, none, none, none, none
        s, i, words, far = np.concatenate(found, axis=1)
        text = np.searchsorted(at[:-1] + np.arange(1, len(n) + 1) * gap, s, "right") - 1
        order = np.lexsort((s, far, i, text))
        text, i, s, words, far = text[order], i[order], s[order], words[order], far[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (i[1:] != i[:-1])
        text, i, s, words, far = text[first], i[first], s[first], words[first], far[first]
        return text, i, s - (at[text] + (text + 1) * gap), words, far


def _ladder(most: int) -> Iterator[int]:
    """Sizes of windows: each a tenth more than the one before."""
    size = 1
    while size <= most:
        yield size
        size = _next(size)


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with k random edits."""
    out = words.tolist()
    for _ in range(k):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        if kind == 0:
            out[at] = int(rng.integers(1 << 62)) | 1
        elif kind == 1:
            out.insert(at, int(rng.integers(1 << 62)) | 1)
        elif len(out) > 1:
            del out[at]
    return np.array(out, _U)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark's items with text, in blocks of about block_bytes: its whole size is looked at first."""
    items = benchmark.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = sorted(own.collect(), key=lambda r: (r.id is not None, r.id, r.text))
        if rows:
            yield [r.id for r in rows], [r.text for r in rows]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    *,
    max_share: float = 0.2,
    target_recall: float = 0.95,
    min_words: int = 1,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with leaks: an array of (item_id, start, n_words, distance) for each benchmark item that the text holds.

    A text holds an item if some run of its words is within max_share * (the item's words), rounded down, edits of
    whole words from it; start and n_words say which words, the closest run, then the first. Words are folded
    (letters and digits, case aside; each character of a script without spaces is a word). So items of under five words are
    found where their words stand as they are. Candidates come from CGK embeddings: the windows of an item's size (of its
    class of sizes, a tenth apart) at every word are embedded by random walks, a few coordinates of each
    walk are sampled, and windows whose samples equal an item's are checked by their exact edit distance. Of items
    of more than 2 * PIECE words pieces all over the item are embedded, and the check finds where a match starts.
    There are as many walks in a class as make copies with random edits up to the greatest distance meet their items with
    target_recall, which is measured (walks_for); exact copies always do. Windows that hold too few of the items' words for any
    match are never embedded.

    Each text is searched where it lies: nothing is shuffled. The benchmark goes to the tasks in blocks of about
    block_bytes, one pass over docs each; where there are several, what each finds is written to the shared folder
    and joined in the end. Null or empty text: no leaks (an empty array); so with an empty
    benchmark. Items without words, or of fewer than min_words, are not looked for. Items of equal texts are found each. Equal rows get equal results; other columns pass
    through; one named leaks is replaced.
    """
    item_type = benchmark.schema[item_id_col].dataType
    leak = T.StructType([T.StructField("item_id", item_type), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.LongType())])
    docs = docs.select(*(quoted(c) for c in docs.columns if c != "leaks"))
    none = F.array().cast(T.ArrayType(leak))
    made = (Items(ids, texts, max_share, target_recall, min_words) for ids, texts in _blocks(benchmark, item_id_col, item_text_col, block_bytes))
    items = next(made, None)
    after = next(made, None)
    if after is None:
        return _search(docs, items, text_col, leak)[0] if items and items.classes else docs.withColumn("leaks", none)
    # a pass for each block, its finds written before the next: never more than two blocks on the driver
    p = prefix_for(docs)
    a, b = f"{p}a", f"{p}b"
    keyed = docs.withColumns(dict(zip((a, b), key2(quoted(text_col)), strict=True)))  # what is found depends on the text alone
    path = scratch(docs.sparkSession, "leaks")
    n = 0
    while items is not None:
        n += 1
        if items.classes:
            found, shipped = _search(keyed.select(quoted(text_col).alias("text"), a, b), items, "text", leak)
            found.where(F.size("leaks") > 0).select(a, b, F.lit(n).alias("block"), "leaks").dropDuplicates([a, b]).write.mode("append").parquet(path)
            shipped.destroy()
        items, after = after, next(made, None)
    schema = T.StructType([T.StructField(a, T.LongType()), T.StructField(b, T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("leaks", T.ArrayType(leak))])
    each = docs.sparkSession.read.schema(schema).parquet(path)
    once = each.groupBy(a, b).agg(F.sort_array(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return keyed.join(once, [a, b], "left").select(*(quoted(c) for c in docs.columns), F.coalesce("leaks", none).alias("leaks"))


def _search(docs: DataFrame, items: Items, text_col: str, leak: T.StructType) -> tuple[DataFrame, Broadcast]:
    """docs with the leaks of a block of items, and the block as it was shipped."""
    from pyspark.sql.pandas.types import to_arrow_type

    shipped = docs.sparkSession.sparkContext.broadcast(items)  # bounded by the block
    kind, at = to_arrow_type(leak["item_id"].dataType), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", T.ArrayType(leak))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for whole in batches:
            for batch in turns(whole, at, 4 << 20):
                text, item, start, words, far = known.search(batch.column(at))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
                found = pa.StructArray.from_arrays(
                    [pa.array([known.ids[i] for i in item.tolist()], kind), pa.array(start, pa.int64()), pa.array(words, pa.int64()), pa.array(far, pa.int64())],
                    names=["item_id", "start", "n_words", "distance"],
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), found)], names=[*batch.schema.names, "leaks"])

    return docs.mapInArrow(run, schema), shipped


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
