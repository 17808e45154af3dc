"""What a worker remembers of pieces of text: their bytes and token ids, found by hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .word_hashes import mix, same_spans

_U = np.uint64


def _longer(held: np.ndarray, need: int) -> np.ndarray:
    """held with room for `need`."""
    if need <= len(held):
        return held
    out = np.zeros(max(need, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class PieceMemo:
    """A hash table in arrays, of about `most` pieces and `most_bytes` of them: when full it starts anew, so that its memory
    is bounded by that and by a batch's own pieces.

    A hash only says where to look: each hit's bytes are compared, and a piece that finds another goes on to a second
    hash, and so on. So pieces whose hashes collide have their own ids.
    """

    def __init__(self, most: int, most_bytes: int = 64 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.forget()

    def forget(self, room: int = 0) -> None:
        self.slots = 2 << (max(self.most, room) - 1).bit_length()  # half of them stay free
        self.key, self.value = np.zeros(self.slots, _U), np.zeros(self.slots, np.int32)
        self.n = self.n_ids = self.n_bytes = 0
        self.flat, self.pool = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.uint8)
        self.starts, self.counts, self.where, self.sizes = np.zeros((4, 1 << 16), np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        last = self.slots - 1
        slot = (hashes & _U(last)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            held = self.key[slot]
            hit = held == hashes[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & last
        return out

    def _remember(self, hashes: np.ndarray, pieces: list[bytes], parts: list[np.ndarray]) -> None:
        """Add pieces of distinct hashes that aren't there, and their ids."""
        n, counts, sizes = len(parts), np.array([len(p) for p in parts], np.int64), np.array([len(p) for p in pieces], np.int64)
        ids, raw = np.concatenate(parts), np.frombuffer(b"".join(pieces), np.uint8)
        self.starts, self.counts, self.where, self.sizes = (_longer(x, self.n + n) for x in (self.starts, self.counts, self.where, self.sizes))
        self.flat, self.pool = _longer(self.flat, self.n_ids + len(ids)), _longer(self.pool, self.n_bytes + len(raw))
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.pool[self.n_bytes : self.n_bytes + len(raw)] = raw
        own = slice(self.n, self.n + n)
        self.counts[own], self.starts[own] = counts, self.n_ids + np.cumsum(counts) - counts
        self.sizes[own], self.where[own] = sizes, self.n_bytes + np.cumsum(sizes) - sizes
        entry = np.arange(self.n, self.n + n)
        self.n, self.n_ids, self.n_bytes = self.n + n, self.n_ids + len(ids), self.n_bytes + len(raw)
        last, slot = self.slots - 1, (hashes & _U(self.slots - 1)).astype(np.int64)
        while len(hashes):
            free = self.key[slot] == 0
            self.key[slot[free]] = hashes[free]
            won = self.key[slot] == hashes
            self.value[slot[won]] = entry[won]
            hashes, entry, slot = hashes[~won], entry[~won], (slot[~won] + 1) & last

    def entries(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[bytes]], list[np.ndarray]], source: np.ndarray | None = None) -> np.ndarray:
        """The entry of each piece raw[start:end]. learn makes the ids of new pieces, of their bytes in `source` if that is
        given, a form of raw of the same places."""
        hashes, sizes = np.maximum(hashes, _U(1)), ends - starts
        anew = False
        while True:
            entry = self.find(hashes)
            new = np.flatnonzero(entry < 0)
            fresh, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            full = self.n + len(fresh) > self.slots // 2 or self.n_bytes + int(sizes[at].sum()) > self.most_bytes
            if len(fresh) and full and not anew:
                self.forget(len(hashes))  # once a batch, so that its own pieces stay
                anew = True
                continue
            for lo in range(0, len(fresh), 50_000):
                some = at[lo : lo + 50_000]
                bounds = list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))
                pieces = [raw[a:b].tobytes() for a, b in bounds]
                self._remember(fresh[lo : lo + 50_000], pieces, learn(pieces if source is None else [source[a:b].tobytes() for a, b in bounds]))
            if len(fresh):
                entry[new] = self.find(hashes[new])
            other = self.sizes[entry] != sizes
            alike = np.flatnonzero(~other)
            other[alike] = ~same_spans(raw, starts[alike], self.pool[: self.n_bytes], self.where[entry[alike]], sizes[alike])
            if not other.any():
                return entry
            hashes = np.where(other, np.maximum(mix(hashes + _U(0x9E3779B97F4A7C15)), _U(1)), hashes)

    def ids(self, entry: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each text has): pieces start at `starts`, texts at `at`, the last being the end."""
        counts = self.counts[entry]
        total = np.cumsum(counts)
        place = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.starts[entry] - (total - counts), counts)
        upto = np.concatenate([[0], total])[np.searchsorted(starts, at)]
        return self.flat[place], np.diff(upto)
