"""Content-defined fragments: each window of words belongs to the one that its least k-gram names."""

from __future__ import annotations

import numpy as np

from .word_hashes import gram_hashes, mix

_U = np.uint64
_PLACES = 26
#: Windows of a fragment at most: a bit of an int64 each.
MOST_WINDOWS = 63
_MASK = _U((1 << _PLACES) - 1)


def fragments(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, count, text) of the fragments of texts whose word hashes are words[bounds[i]:bounds[i + 1]].

    A window's anchor is the leftmost of its k-grams of least hash. Windows next to each other that share an
    anchor are a fragment, or several of at most MOST_WINDOWS: `count` windows from word `first` of text `text` on. A window's anchor depends on its
    own words alone, so equal windows have equal anchors wherever they are. anchor is the k-gram's hash.
    """
    none = np.zeros(0, np.int64)
    n = len(words) - window + 1
    if n <= 0:
        return none.astype(_U), none, none, none
    if len(words) >> _PLACES:
        raise ValueError("more words at a time than places")
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    grams = gram_hashes(words, gram)
    low = (grams & ~_MASK) | np.arange(len(grams), dtype=_U)
    span, have = window - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    at = (low & _MASK).astype(np.int64)[:n]
    whole = np.flatnonzero(np.arange(n) + window <= bounds[1:][text])
    if not len(whole):
        return none.astype(_U), none, none, none
    at, text = at[whole], text[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(whole)))
    parts = -(-size // MOST_WINDOWS)
    if parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + nth * MOST_WINDOWS
    return mix(grams[at[first]]), whole[first], np.diff(np.append(first, len(whole))), text[first]


_STEP = 0xA0761D6478BD642F
_BACK = pow(_STEP, -1, 1 << 64)


def run_hashes(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of each run of four words or more, by its start and length: of its 4-grams, which leaves alternating words
    no pattern under which sums modulo a power of two cancel."""
    words, length = gram_hashes(words, 4), length - 3
    n = len(words)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(max(0, n - 1), b, _U)])) for b in (_STEP, _BACK))
    total = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[first + length] - total[first]) * down[first] + length.astype(_U)) if len(first) else np.zeros(0, _U)
