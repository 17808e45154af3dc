"""Words of Arrow string columns as 64-bit hashes, computed over the column's buffer as a whole."""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that are hashed at a time; a longer text makes its own, longer turn.
TURN = 1 << 20

_byte = np.arange(256)
#: ASCII white space; and everything in ASCII but letters and digits.
SPACES = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
MARKS = (_byte < 128) & ~((_byte >= 48) & (_byte <= 57)) & ~((_byte >= 65) & (_byte <= 90)) & ~((_byte >= 97) & (_byte <= 122))
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (splitmix64's finish)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: The low bytes of a word of eight, by how many are wanted.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Spans of more bytes are hashed one by one.
_LONG = 512


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each starts and the last ends). A null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)), offsets - lo


def fold_ascii(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, as a copy."""
    return _LOWER[raw]


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of raw on as a number; past the end there are zeros."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded.data, 0, (1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of raw[start:end] for each pair, the same on every machine.

    Eight bytes at a time are mixed in, so spans of one length of up to eight bytes never collide, and there is no algebra
    by which longer ones do, as there is with polynomials modulo a power of two. Very long spans go by blake2b.
    """
    words = eights(raw)
    size = ends - starts
    out = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    at, left, on = starts, size, np.flatnonzero(size <= _LONG)
    if len(on) < len(size):
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        at, left = at[on], left[on]
    while len(on):
        out[on] = mix(out[on] ^ (words[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return out


def same_spans(raw: np.ndarray, starts: np.ndarray, pool: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether raw and pool hold the same bytes from the places on, as many as sizes say."""
    here, there = eights(raw), eights(pool)
    out, on, done = np.ones(len(starts), bool), np.flatnonzero(sizes <= _LONG), 0
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = np.array_equal(raw[starts[i] : starts[i] + sizes[i]], pool[others[i] : others[i] + sizes[i]])
    while len(on):
        differ = (here[starts[on] + done] ^ there[others[on] + done]) & _LOW_BYTES[np.minimum(sizes[on] - done, 8)] != 0
        out[on[differ]] = False
        on = on[~differ & (sizes[on] - done > 8)]
        done += 8
    return out


def word_hashes(texts: pa.Array, *, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, where each text's words start). Null texts have no words.

    Words are runs of anything but ASCII white space, as they are; with fold, of letters, digits and combining marks, small
    and capital letters alike (but for the few whose small letter takes another number of bytes), and each
    character of a script without spaces (UNSPACED) is a word. Equal words have equal hashes
    on every machine; others differ but for a chance of about 2**-64 a pair.
    """
    raw, at = buffer_of(texts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    if not len(raw):
        return np.zeros(0, _U), bounds
    parts, first, done = [], 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + TURN, "right")) - 1)
        own = raw[at[first] : at[last]]
        if len(own):
            hashes, starts = _turn(own, at[first : last + 1] - at[first], fold)
            parts.append(hashes)
            bounds[first + 1 : last + 1] = done + np.searchsorted(starts, at[first + 1 : last + 1] - at[first])
            done += len(hashes)
        else:
            bounds[first + 1 : last + 1] = done
        first = last
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), bounds


def _turn(raw: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    alone = None
    if fold:
        gap = MARKS[raw]
        raw = _LOWER[raw]
        alone = _fold_wide(raw, gap)
    else:
        gap = SPACES[raw]
    edge = at[(at > 0) & (at < len(raw))]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[edge] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[edge - 1] = True
    if alone is not None and len(alone):
        first, last = alone
        before[first] = after[last] = True
        before[np.minimum(last + 1, len(raw) - 1)[last + 1 < len(raw)]] = True
        after[(first - 1)[first > 0]] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return span_hashes(raw, starts, ends), starts


#: Code points of scripts that are written without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _kind(c: int) -> int:
    """0 for a letter, digit or combining mark, 1 for any other character, 2 for one that is a word alone."""
    if unicodedata.category(chr(c))[0] not in "LNM":
        return 1
    return 2 if any(a <= c <= b for a, b in UNSPACED) else 0


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind and small letter of each code point of up to three bytes."""
    kind, lower = np.ones(1 << 16, np.uint8), np.arange(1 << 16)
    for c in (*range(0x80, 0xD800), *range(0xE000, 1 << 16)):
        kind[c] = _kind(c)
        low = chr(c).casefold() if len(chr(c).casefold()) == 1 else chr(c).lower()
        if len(low) == 1 and len(low.encode()) == len(chr(c).encode()):
            lower[c] = ord(low)
    return kind, lower


def _fold_wide(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold the characters beyond ASCII in place: small letters, and gaps for marks. Returns the first and last bytes of
    characters that are words alone."""
    firsts, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wide = np.flatnonzero(raw >= 0xC2)
    lead = raw[wide]
    for size, low, high, top in ((2, 0xC2, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0xF5, 7)):
        at = wide[(lead >= low) & (lead < high)]
        at = at[at + size <= len(raw)]
        if not len(at):
            continue
        code = (raw[at] & top).astype(np.int64)
        for k in range(1, size):
            code = code << 6 | raw[at + k] & 63
        if size < 4:
            kinds, lower = _characters()
            kind, small = kinds[code], lower[code]
            turned = np.flatnonzero(small != code)
            for k in range(size):
                bits = small[turned] >> 6 * (size - 1 - k) & (63 if k else top)
                raw[at[turned] + k] = bits | (0x80 if k else low & ~top if size == 2 else 0xE0)
        else:
            some, where = np.unique(code, return_inverse=True)
            kind = np.array([_kind(c) if c < 0x110000 else 1 for c in some.tolist()], np.uint8)[where]
        for k in range(size):
            gap[at[kind == 1] + k] = True
        firsts.append(at[kind == 2])
        lasts.append(at[kind == 2] + size - 1)
    return np.concatenate(firsts), np.concatenate(lasts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, by its first word; the last k - 1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out = mix((out ^ words[j : j + n]) + _U(0x9FB21C651E98DF25))
    return out


def turns(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text, a row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        have = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, have + size, "right")))
        yield batch.slice(first, last - first)
        first = last
