"""Token ids in binary files: encode texts, write patched frame-of-reference files, read them back."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, quoted, read_table, scratch
from .pfor import BLOCK, Reader, Writer
from .piece_memo import PieceMemo
from .word_hashes import MARKS, SPACES, buffer_of, fold_ascii, span_hashes, turns

#: Entries of a worker's memo of pieces; it starts anew when full, so its memory is bounded.
_MEMO = 1 << 20
_WORD_ENDS = "</w>"
# The tokenizer file's parts under which texts may be encoded by pieces.
_NORMALIZERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTERS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A file holds about so many bytes of text, and no more than about so many documents.
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20

# Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 other marks.
_byte = np.arange(256)
_KIND = np.where(SPACES, 0, np.where((_byte >= 48) & (_byte <= 57), 2, np.where(MARKS, 3, 1))).astype(np.uint8)
#: Bytes that make a word one piece: ' starts contractions, < special tokens, and control characters may be spaces.
_ODD = (_byte == 0x27) | (_byte == 0x3C) | ((_byte < 32) & ~SPACES) | (_byte == 127)


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library.

    One whose file has the normalizers and splitters of _NORMALIZERS and _SPLITTERS, ends of words and no special token
    with white space lower-cases, and its ids of a text are those of its runs of letters, its digits and its
    runs of other marks, one after another. So each such piece is encoded once and remembered,
    and texts are put together from pieces. A word with anything else in it (letters beyond Latin-1, quotes,
    control characters, what may be a special token) is one piece, as it is. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = [t["content"] for t in made.get("added_tokens") or []]
        self.by_pieces = (
            made.get("normalizer") == _NORMALIZERS and made.get("pre_tokenizer") == _SPLITTERS and made["model"].get("type") == "BPE" and made["model"].get("end_of_word_suffix") == _WORD_ENDS
            and not made["model"].get("dropout") and not made.get("truncation") and not made.get("padding")
            and all(t.startswith("<") and not any(c.isspace() for c in t) for t in added) and not any(t.get("lstrip") or t.get("rstrip") for t in made.get("added_tokens") or [])
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(_WORD_ENDS)
        self.memo = PieceMemo(_MEMO)

    def _learn(self, pieces: list[bytes]) -> list[np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        parts: list[np.ndarray | None] = [None] * len(texts)
        words = [i for i, t in enumerate(texts) if t.isalpha() and t.isascii() or t.isalpha() and max(t) < "\u0100"]
        groups = [words[lo : lo + 64] for lo in range(0, len(words), 64)]
        found = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some]) for some in groups], add_special_tokens=False)
        for some, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1  # one token ends each word
            if len(cuts) == len(some):
                start = 0
                for i, end in zip(some, cuts.tolist(), strict=True):
                    parts[i] = ids[start:end]
                    start = end
        rest = [i for i, p in enumerate(parts) if p is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        raw, at = buffer_of(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if not self.by_pieces:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        own, starts, ends = self._pieces(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        return self.memo.ids(self.memo.entries(span_hashes(own, starts, ends), own, starts, ends, self._learn, raw), starts, at)

    @staticmethod
    def _pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(raw with A-Z in lower case but for words that are one piece, where pieces start, where they end)."""
        kind, own = _KIND[raw], fold_ascii(raw)
        high = raw >= 0x80
        odd = _ODD[raw]
        if high.any():
            latin = np.zeros(len(raw), bool)  # C3 and what follows it, but for the signs of multiplication and division
            lead = np.flatnonzero(raw[:-1] == 0xC3)
            lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] <= 0xBF) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
            latin[lead] = latin[lead + 1] = True
            odd |= high & ~latin
        edge = at[(at > 0) & (at < len(raw))]
        if odd.any():
            before = np.ones(len(raw), bool)
            before[1:] = kind[:-1] == 0
            before[edge] = True
            words = np.flatnonzero(before & (kind != 0))
            hit = np.unique(np.searchsorted(words, np.flatnonzero(odd), "right") - 1)
            gaps = np.union1d(np.flatnonzero(kind == 0), np.append(edge, len(raw)))
            stop = gaps[np.searchsorted(gaps, words[hit], "right")]
            inside = np.zeros(len(raw) + 1, np.int8)
            np.add.at(inside, words[hit], 1)
            np.add.at(inside, stop, -1)
            inside = np.cumsum(inside[:-1]).astype(bool)
            kind[inside] = 4
            own[inside] = raw[inside]
        turn = np.ones(len(raw), bool)
        turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        turn[edge] = True
        cuts = np.flatnonzero(turn)
        solid = kind[cuts] != 0
        return own, cuts[solid], np.append(cuts[1:], len(raw))[solid]


_ENCODERS: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", *, files: int | None = None, block: int = BLOCK, percentile: float = 90.0) -> DataFrame:
    """Encode every text and write the ids to files in `folder`, in ascending id order; returns the manifest.

    The rows are dealt out by ranges of id (ties by a hash of the text), so file k holds smaller ids than file k + 1; each
    task encodes and writes its range as a stream. A file is written under a task's own name and then
    renamed, so a task that runs again leaves one whole file. There are as many files as bytes and documents ask for
    (FILE_BYTES, FILE_DOCS), unless `files` says how many. The folder must be one that all
    executors share. end_id, if any, is appended to each document. Null text counts as empty; null ids come
    first, and rows of one id are in the order of their texts' hashes. The manifest, one row a file: file, path, n_docs,
    n_ids and start, the ids of all files before it.
    """
    spark = docs.sparkSession
    if not files:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(quoted(text_col))), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
        small = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["size"] // (4 << 20)))  # a small table may still use all cores
        files = max(1, small, -(-size["size"] // FILE_BYTES), -(-size["n"] // FILE_DOCS))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    # the bounds of the ranges pass through the driver: ids and hashes, not texts
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        context = TaskContext.get()
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        final = f"{base}/tokens-{context.partitionId():06d}.pfor"
        part = f"{final}.{context.taskAttemptId()}.tmp"
        end = np.array([] if end_id is None else [end_id], np.uint32)
        with system.open_output_stream(part) as out:
            writer = Writer(out, block, percentile)
            for whole in batches:
                for batch in turns(whole, 1, 2 << 20):
                    ids, counts = encoder.encode(batch.column(1))
                    stops = np.cumsum(counts).tolist()
                    for doc, a, b in zip(batch.column(0).to_pylist(), [0, *stops[:-1]], stops, strict=True):
                        writer.add(doc, np.concatenate([ids[a:b], end]))
            writer.close()
        system.move(part, final)
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([context.partitionId()], pa.int32()), "path": [final if folder.startswith("/") else f"{folder}/{final.rsplit('/', 1)[1]}"],
            "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()),
        })

    made = rows.mapInArrow(run, "file int, path string, n_docs long, n_ids long").collect()  # a row for each file
    made.sort(key=lambda r: r.file)
    before = [0, *accumulate(r.n_ids for r in made)]
    listed = [(r.file, r.path, r.n_docs, r.n_ids, b) for r, b in zip(made, before, strict=False)]
    return spark.createDataFrame(listed, "file int, path string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_le) of every document in the manifest's files.

    start: the ids of all documents before it; ids_le: its ids as little-endian unsigned 32-bit integers.
    A file is read as a stream by one task, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = filesystem(path)
                with system.open_input_file(name) as source:
                    out, size = [], 0
                    for doc, start, ids in Reader(source, source.size()).documents():
                        out.append((doc, base + start, len(ids), ids.tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _batch(out)
                            out, size = [], 0
                    if out:
                        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "n_tokens", "ids_le"])

    files = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = manifest.repartition(files, "file").select("path", "start").mapInArrow(run, "id long, start long, n_tokens long, ids_le binary")
    return read.withColumnRenamed("id", id_col)


#: What the query's contract states: the vocabulary and the id that ends each document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_token_files(docs, scratch(spark, "tokens"), public_tokenizers.path(VOCABULARY), END_ID)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
