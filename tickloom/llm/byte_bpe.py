"""Byte-level BPE: encoding by merge ranks on a segment tree, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, read_table
from .piece_memo import PieceMemo
from .word_hashes import buffer_of, span_hashes, turns

_NONE = np.int64(1) << 50
#: Pieces of up to so many bytes are merged side by side, a tree each; longer ones have a tree alone.
_SIDE_BY_SIDE = 64
#: Entries of a worker's memo of chunks.
_MEMO = 1 << 21
_ROWS = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Ranks:
    """A rank file as tables: token bytes by id, and the rank of each pair of ids that merges."""

    def __init__(self, path: str):
        self.of = load_ranks(path)
        self.token = {i: t for t, i in self.of.items()}
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for whole, rank in self.of.items():
            for k in range(1, len(whole)):
                a, b = self.of.get(whole[:k]), self.of.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pair = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_long(piece: bytes, r: Ranks) -> list[int]:
    """Merge one piece. Leaf i of the tree holds the rank and place of the pair that starts at byte i;
    an inner node holds the lesser of its two, so the root is the leftmost pair of least rank."""
    n = len(piece)
    ids = r.byte[np.frombuffer(piece, np.uint8)].tolist()
    size = 1 << max(1, (n - 1).bit_length())
    none = int(_NONE)
    step = 1 << max(1, n.bit_length())
    pair = r.pair
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pair.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * step + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (root := tree[1]) < none:
        rank, i = divmod(root, step)
        gone = after[i]
        nxt = after[gone]
        ids[i] = rank
        after[i] = nxt
        ids[gone] = -1
        put(gone, none)
        if nxt < n:
            before[nxt] = i
            rank = pair.get(ids[i] << 20 | ids[nxt])
            put(i, none if rank is None else rank * step + i)
        else:
            put(i, none)
        if (b := before[i]) >= 0:
            rank = pair.get(ids[b] << 20 | ids[i])
            put(b, none if rank is None else rank * step + b)
    return [x for x in ids if x >= 0]


def merge_many(pieces: list[bytes], r: Ranks) -> list[bytes]:
    """merge_long for pieces of at most _SIDE_BY_SIDE bytes: one tree a row, a merge of every row at a
    time. Returns each piece's ids as int32 bytes."""
    lens = np.array([len(p) for p in pieces], dtype=np.int64)
    out: list[bytes] = [b""] * len(pieces)
    sizes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for lo in range(0, len(rows), 1 << 14):
            some = rows[lo : lo + (1 << 14)]
            _merge_block([pieces[i] for i in some], lens[some], size, r, some, out)
    return out


def _merge_block(pieces: list[bytes], lens: np.ndarray, size: int, r: Ranks, where: np.ndarray, out: list[bytes]) -> None:
    count = len(pieces)
    inside = np.arange(size)[None, :] < lens[:, None]
    ids = np.full((count, size), -1, dtype=np.int64)
    ids[inside] = r.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, size + 1), (count, 1))
    before = np.tile(np.arange(-1, size - 1), (count, 1))
    tree = np.full((count, 2 * size), _NONE, dtype=np.int64)
    y, x = np.nonzero(inside[:, 1:])
    rank = r.ranks(ids[y, x], ids[y, x + 1])
    has = rank >= 0
    tree[y[has], size + x[has]] = rank[has] * size + x[has]
    k = size // 2
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k //= 2

    def put(y: np.ndarray, x: np.ndarray, value: np.ndarray | np.int64) -> None:
        k = size + x
        tree[y, k] = value
        k = k >> 1
        while k[0]:  # all leaves are at one depth
            tree[y, k] = np.minimum(tree[y, 2 * k], tree[y, 2 * k + 1])
            k = k >> 1

    def pair(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = r.ranks(ids[y, a], ids[y, b])
        return np.where(rank >= 0, rank * size + a, _NONE)

    y = np.flatnonzero(tree[:, 1] < _NONE)
    while len(y):
        root = tree[y, 1]
        x = root % size
        gone = after[y, x]
        nxt = after[y, gone]
        ids[y, x] = root // size
        ids[y, gone] = -1
        after[y, x] = nxt
        put(y, gone, _NONE)
        put(y, x, _NONE)
        on = nxt < lens[y]
        if on.any():
            before[y[on], nxt[on]] = x[on]
            put(y[on], x[on], pair(y[on], x[on], nxt[on]))
        b = before[y, x]
        on = b >= 0
        if on.any():
            put(y[on], b[on], pair(y[on], b[on], x[on]))
        y = y[tree[y, 1] < _NONE]
    alive = ids >= 0
    flat = ids[alive].astype("<i4").tobytes()
    ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
    start = 0
    for i, end in zip(where.tolist(), ends, strict=True):
        out[i] = flat[start:end]
        start = end


class Encoder:
    """Encodes texts as the rank file and the split pattern say.

    No match of the pattern reaches over a single white space character followed by a non-space but for
    the space that starts it. So a text without two white space characters in a row is the
    concatenation of its lines' chunks ("word" at a line's start, " word" elsewhere), and each chunk
    is encoded once and remembered. Other texts are matched whole.
    """

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        self.ranks = Ranks(path)
        # \s as Unicode's White_Space; this library's \s also takes 1C-1F
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")).findall
        self.two = re.compile(r"\s\s").search
        self.memo = PieceMemo(_MEMO)

    def _ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts that are split into the pattern's matches."""
        known, done, short = self.ranks.of, {}, []
        for p in {p for s in split for p in s}:
            raw = p.encode("utf-8", "surrogatepass")
            if (i := known.get(raw)) is not None:
                done[p] = i.to_bytes(4, "little")
            elif len(raw) > _SIDE_BY_SIDE:
                done[p] = np.array(merge_long(raw, self.ranks), dtype="<i4").tobytes()
            else:
                short.append((p, raw))
        if short:
            done.update(zip((p for p, _ in short), merge_many([x for _, x in short], self.ranks), strict=True))
        return [np.frombuffer(b"".join([done[p] for p in s]), "<u4") for s in split]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Each text's ids. Null and empty texts have none."""
        strings = texts.to_pylist()
        whole = [i for i, t in enumerate(strings) if t and self.two(t)]
        raw, at = buffer_of(texts)
        chunked = np.ones(len(strings), bool)
        chunked[whole] = False
        flat, counts = np.zeros(0, np.uint32), np.zeros(len(strings), np.int64)
        if len(raw):
            line = raw == 10
            starts = (raw == 32) | line
            starts[1:] |= line[:-1]
            starts[at[:-1][at[:-1] < len(raw)]] = True
            starts = np.flatnonzero(starts)
            ends = np.append(starts[1:], len(raw))
            own = chunked[np.searchsorted(at, starts, "right") - 1]
            starts, ends = starts[own], ends[own]
            if len(starts):
                learn = lambda pieces: self._ids([self.find(p.decode("utf-8", "surrogatepass")) for p in pieces])
                flat, counts = self.memo.ids(self.memo.entries(span_hashes(raw, starts, ends), raw, starts, ends, learn), starts, at)
        if whole:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i, ids in zip(whole, self._ids([self.find(strings[i]) for i in whole]), strict=True):
                parts[i], counts[i] = ids, len(ids)
            flat = np.concatenate(parts)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode_bpe(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with ids_col array<int>: the text's ids, each match of pattern merged separately. With decoded_col also what
    decode_bpe makes of the ids, by the same worker: a second pass would need a second worker for each task.

    The ids are those of the tiktoken library's encode_ordinary: a match that is a token is that token;
    else the leftmost pair of least rank merges until none is left. The segment tree makes a match of n
    bytes O(n log n), however long. Null or empty text: no ids. Other columns pass through; one named
    ids_col is replaced. No shuffle; a worker remembers a bounded number of chunks.
    """

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks_path, pattern) not in _ENCODERS:
            _ENCODERS[ranks_path, pattern] = Encoder(ranks_path, pattern)
        encoder = _ENCODERS[ranks_path, pattern]
        for whole in batches:
            for batch in turns(whole, at, 2 << 20):
                batch = _with(batch, ids_col, encoder.encode(batch.column(at)))
                yield batch if decoded_col is None else _with(batch, decoded_col, _decoded(batch.column(batch.num_columns - 1), encoder.ranks.token))

    schema = _schema(df, ids_col, T.ArrayType(T.IntegerType()))
    if decoded_col is not None:
        schema = T.StructType([*(f for f in schema.fields if f.name != decoded_col), T.StructField(decoded_col, T.BinaryType())])
    return df.mapInArrow(run, schema)


def _decoded(lists: pa.ListArray, token: dict[int, bytes]) -> pa.Array:
    flat, ends, find = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), token.__getitem__
    return pa.array([b"".join(map(find, flat[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def decode_bpe(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col binary: the bytes of the tokens. Null or no ids: no bytes. An id that no token
    has raises KeyError. Other columns pass through; one named out_col is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks_path not in _TOKENS:
            _TOKENS[ranks_path] = {i: t for t, i in load_ranks(ranks_path).items()}
        token = _TOKENS[ranks_path]
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                yield _with(batch, out_col, _decoded(batch.column(batch.schema.names.index(ids_col)), token))

    return df.mapInArrow(run, _schema(df, out_col, T.BinaryType()))


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs(doc_id, text)."""
    coded = encode_bpe(docs.select("doc_id", "text"), ranks_path, pattern, decoded_col="decoded")
    listed = F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(","))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents").select(quoted("doc_id"), quoted("text")), *public_ranks())
