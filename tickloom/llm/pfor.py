"""Patched frame-of-reference blocks of unsigned 32-bit integers, and files of them.

File, all little-endian: MAGIC; blocks one after another; the directory (as many int64 ids, uint8 "has
an id" and int64 counts as there are documents); the index (a uint64 start for each block and one
for the end); and a footer of five uint64: directory start, index start, documents, blocks, ids.
Block: header (uint32 count, minimum, exceptions and width), the low `width` bits of each value less
the minimum, packed; then the exceptions' places (uint16) and whole differences (uint32).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"TLPFOR01"
BLOCK = 4096
_HEAD = struct.Struct("<IIII")
_FOOT = struct.Struct("<QQQQQ")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of uint32 values, lowest first."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(raw: bytes, count: int, width: int) -> np.ndarray:
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_block(values: np.ndarray, percentile: float = 90.0) -> bytes:
    """One block of at most 65,536 values. The width is that of the percentile of the differences to the
    minimum; larger differences are exceptions."""
    if not len(values):
        return _HEAD.pack(0, 0, 0, 0)
    low = int(values.min())
    gap = (values.astype(np.int64) - low).astype(np.uint32)
    at = min(len(gap) - 1, int(len(gap) * percentile / 100))
    width = int(np.partition(gap, at)[at]).bit_length()
    over = np.flatnonzero(gap >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return _HEAD.pack(len(gap), low, len(over), width) + pack(gap, width) + over.astype("<u2").tobytes() + gap[over].astype("<u4").tobytes()


def decode_block(raw: bytes | memoryview) -> np.ndarray:
    count, low, n_over, width = _HEAD.unpack_from(raw)
    at = _HEAD.size
    size = (count * width + 7) // 8
    gap = unpack(bytes(raw[at : at + size]), count, width) if count else np.zeros(0, "<u4")
    at += size
    places = np.frombuffer(raw, "<u2", n_over, at)
    gap[places] = np.frombuffer(raw, "<u4", n_over, at + 2 * n_over)
    return (gap.astype(np.int64) + low).astype("<u4")


class Writer:
    """Writes documents' ids to an open file, a block at a time; memory holds a block and the directory."""

    def __init__(self, out, block: int = BLOCK, percentile: float = 90.0):
        self.out, self.block, self.percentile = out, block, percentile
        self.at, self.starts, self.ids, self.counts = 0, [], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(flat) if last else len(flat) // self.block * self.block
        for lo in range(0, end, self.block):
            self.starts.append(self.at)
            self._put(encode_block(flat[lo : min(end, lo + self.block)], self.percentile))
        self.held, self.n_held = [flat[end:]], len(flat) - end

    def close(self) -> None:
        self._flush(True)
        directory = self.at
        self._put(np.array([x or 0 for x in self.ids], "<i8").tobytes())
        self._put(np.array([x is not None for x in self.ids], np.uint8).tobytes())
        self._put(np.array(self.counts, "<i8").tobytes())
        index = self.at
        self._put(np.array([*self.starts, directory], "<u8").tobytes())
        self._put(_FOOT.pack(directory, index, len(self.ids), len(self.starts), self.n_ids))


class Reader:
    """Reads a file through any object with seek and read."""

    def __init__(self, source, size: int):
        self.source = source
        if self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        directory, index, self.n_docs, self.n_blocks, self.n_ids = _FOOT.unpack(self._get(size - _FOOT.size, _FOOT.size))
        raw = self._get(directory, index - directory)
        self.ids = np.frombuffer(raw, "<i8", self.n_docs)
        self.has = np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs)
        self.counts = np.frombuffer(raw, "<i8", self.n_docs, 9 * self.n_docs)
        self.starts = np.frombuffer(self._get(index, 8 * (self.n_blocks + 1)), "<u8").astype(np.int64)

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        """Any block alone, by the index."""
        return decode_block(self._get(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in this file, ids) of each document; memory holds a few blocks and a document."""
        held, have, k, start = [], 0, 0, 0
        for doc, has, count in zip(self.ids.tolist(), self.has.tolist(), self.counts.tolist(), strict=True):
            while have < count:
                upto = min(self.n_blocks, k + 64)
                raw = memoryview(self._get(int(self.starts[k]), int(self.starts[upto] - self.starts[k])))
                base = int(self.starts[k])
                for b in range(k, upto):
                    held.append(decode_block(raw[int(self.starts[b]) - base : int(self.starts[b + 1]) - base]))
                    have += len(held[-1])
                k = upto
            flat = np.concatenate(held) if len(held) != 1 else held[0]
            yield (doc if has else None), start, flat[:count]
            held, have, start = [flat[count:]], have - count, start + count
