"""An FM-index of word sequences whose suffixes are ordered by their first `depth` words.

For patterns of up to `depth` words this order is as good as the full one, and it costs log2(depth) sorts. The
Burrows-Wheeler transform is held in a wavelet tree, level by level, as bits with counts. What goes with a place in the order
is held sparsely: where intervals of shared words end as marked bits, weights only where they aren't 1.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        k = at >> 6
        low = self.words[k] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
        return self.before[k] + np.bitwise_count(low)


class Marks:
    """A sorted list of places: a bit for each place, and how many marks stand before it."""

    def __init__(self, places: np.ndarray, size: int):
        bits = np.zeros(size + 1, np.uint8)
        bits[places] = 1
        self.bits, self.places = Bits(bits), places.astype(np.int32)

    def before(self, at: np.ndarray) -> np.ndarray:
        return self.bits.rank(at)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last mark up to each place, and the first one after it."""
        k = self.bits.rank(at + 1)
        return self.places[k - 1].astype(np.int64), self.places[k].astype(np.int64)


class WaveletTree:
    """Rank of any symbol in a sequence of integers below `size`: a level for each bit, from the highest; at each
    level the zeros of the level above come first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(np.uint8)
            self.levels.append((bit, Bits(ones)))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        every = np.arange(size)
        self.base = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.base[symbol]


def _renumber(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(key), np.int64)
    ranks = np.cumsum(np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)]))
    new[order] = ranks
    return order, new


class FMIndex:
    """Index of sequences of words (any integers), each with a weight that says how many times it occurs."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int):
        self.depth, self.lengths = depth, lengths
        alphabet, codes = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        # 0 ends each sequence
        text = np.zeros(len(words) + len(lengths), np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        text[np.arange(len(words)) + owner] = codes + 1
        self.text, self.starts = text.astype(np.int32), ends - lengths + np.arange(len(lengths))
        n, rank, have = len(text), text, 1

        def pair(shift: int) -> np.ndarray:
            then = np.zeros(n, np.int64)
            then[: n - shift] = rank[shift:] + 1 if shift < n else 0
            return rank * (n + 2) + then

        while 2 * have < depth:
            _, rank = _renumber(pair(have) if have < n else rank * (n + 2))
            have *= 2
        less = pair(depth - 1 - have) if 0 < depth - 1 - have < n else rank
        order, _ = _renumber(pair(depth - have) if depth - have < n else rank)
        # where the suffixes that share depth - 1 words start and end
        same = less[order]
        self.edges = Marks(np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1], [True]])), n)
        self.tree = WaveletTree(text[order - 1], len(alphabet) + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(alphabet) + 1))])[:-1]
        own = np.repeat(weights, lengths + 1)[order]
        heavy = np.flatnonzero(own != 1)
        self.heavy, self.more = Marks(heavy, n), np.concatenate([[0], np.cumsum(own[heavy] - 1)])

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The weight of the suffixes of [low, high)."""
        return high - low + self.more[self.heavy.before(high)] - self.more[self.heavy.before(low)]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that start with the symbol and go on as those of [low, high)."""
        first = self.less[symbol]
        return first + self.tree.rank(symbol, low), first + self.tree.rank(symbol, high)

    def repeated(self, least: int = 2) -> np.ndarray:
        """For each sequence, a bit for each of its first 63 runs of `depth` words: set if they occur at least `least` times.

        All sequences are streamed at a time, from their ends: the matching statistics, up to `depth`, of each
        place. Once `depth` words match, the interval's weight is the run's occurrences, and the last word is dropped by widening the
        interval to the suffixes that share the words before it.
        """
        out = np.zeros(len(self.lengths), np.int64)
        line = np.argsort(-self.lengths, kind="stable")
        length, start = self.lengths[line], self.starts[line]
        low, high = np.zeros(len(line), np.int64), np.full(len(line), len(self.text))
        for step in range(int(length[0]) if len(length) else 0):
            on = int(np.searchsorted(-length, -step, "left"))  # those longer than step
            low, high = self.extend(self.text[start[:on] + length[:on] - 1 - step].astype(np.int64), low[:on], high[:on])
            if step >= self.depth - 1:
                hit = self.occurrences(low, high) >= least
                place = length[:on] - 1 - step
                out[line[:on][hit]] |= np.left_shift(np.int64(1), place[hit])
                low, high = self.edges.around(low)
        return out
