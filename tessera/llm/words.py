"""Word and shingle hashing over whole batches of texts with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased where asked. Words get 64-bit
hashes from random byte values weighted by powers of an odd base; a shingle mixes the hashes of its words. Two
different shingles share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]

#: Bytes that are hashed at once; a longer text is taken in pieces that end between words.
PIECE = 1 << 21

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        grown = np.full(size, _BASE & ((1 << 64) - 1), np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text) of all words of texts that lie one after the other."""
    word = np.empty(len(data) + 1, bool)
    word[:-1] = ~SPACE[data]
    word[-1] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    bounds = offsets[:-1]
    first[bounds] = word[bounds]
    starts = np.flatnonzero(first)
    last = word[:-1] & (~word[1:])
    inner = offsets[1:][offsets[1:] > 0] - 1
    last[inner] = word[inner]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    index = np.arange(int(lengths.sum()), dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    place = index - np.repeat(heads, lengths)
    value = (_BYTE_LOWER if lower else _BYTE)[data[place + np.repeat(starts, lengths)]]
    value *= _power(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text). Memory beyond the result is bounded but for one huge word."""
    if len(data) <= PIECE:
        starts, ends, before = spans(data, offsets)
        return _hash_spans(data, starts, ends, lower), before
    found, before = [], np.zeros(len(offsets), np.int64)
    for row in range(len(offsets) - 1):
        at, end, n = int(offsets[row]), int(offsets[row + 1]), 0
        while at < end:
            stop = min(at + PIECE, end)
            while stop < end and not SPACE[data[stop]]:
                gap = np.flatnonzero(SPACE[data[stop : min(stop + PIECE, end)]])
                stop = stop + int(gap[0]) if len(gap) else min(stop + PIECE, end)
            part = data[at:stop]
            s, e, _ = spans(part, np.array([0, len(part)]))
            found.append(_hash_spans(part, s, e, lower))
            n += len(s)
            at = stop
        before[row + 1] = before[row] + n
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), before


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, over text borders too; the caller leaves those out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _PLACE[k % 64] + (_SHORT[k % 64] if k >= 64 else np.uint64(0))
    return mix(out)


def shingle_set(hashes: np.ndarray, all_windows: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
    """The sorted distinct shingles of words first..last; a shorter text is one shingle, an empty one has none."""
    n = last - first
    if n >= size:
        return np.unique(all_windows[first : last - size + 1])
    if n == 0:
        return np.empty(0, np.uint64)
    value = np.add.reduce(hashes[first:last] * _PLACE[:n], keepdims=True) + _SHORT[n : n + 1]
    return mix(value)
