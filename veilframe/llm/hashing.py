"""Hashes of words and of runs of words, over all documents of an Arrow batch at once.

Words are runs of bytes other than space and 0x09 to 0x0D.  A word has two independent 64-bit
multilinear hashes and a run of words two 64-bit sums of them, so that equal keys of 128 bits stand
for equal word sequences.  Work goes in slices, so memory follows the words and not the product of
text and intermediate arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE_WEIGHTS = _random.integers(1, 1 << 63, (2, 1 << 16), dtype=np.uint64) | np.uint64(1)
_WORD_WEIGHTS = _random.integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the number of words of each document."""
    low, high = int(offsets[0]), int(offsets[-1])
    part = data[low:high]
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_WHITE[part]
    cuts = offsets - low
    edges = cuts[(cuts > 0) & (cuts < len(part))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first) + low, np.flatnonzero(last) + 1 + low
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty((2, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        s, base, stop = starts[i:j], int(starts[i]), int(ends[j - 1])
        part = data[base:stop]
        value = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        value[_IS_WHITE[part]] = 0
        place = np.arange(len(part)) - np.repeat(s - base, np.diff(np.append(s, stop)))
        far = place >> 16
        place &= 0xFFFF
        for k in (0, 1):
            weight = _BYTE_WEIGHTS[k][place]
            if far[-1] or far.max():
                weight = weight * (2 * far + 1).astype(np.uint64)
            out[k, i:j] = np.add.reduceat(value * weight, s - base)
        i = j
    return mixed(out[0]), mixed(out[1])


def run_hashes(words: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one document, and the document's place."""
    n = len(words[0]) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[:n] == owner[k - 1 :]
    out = []
    for w, weights in zip(words, _WORD_WEIGHTS, strict=True):
        total = w[:n] * weights[0]
        for j in range(1, k):
            total += w[j : n + j] * weights[j]
        out.append(mixed(total[inside]))
    return out[0], out[1], owner[:n][inside]


def pieces(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about the given number of bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def packed(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as gaps of 7 bits a byte."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    bits = np.ones(len(gaps), np.int64)
    rest = gaps >> np.uint64(7)
    while rest.any():
        bits += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(bits)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    places, rest = ends - bits, gaps
    while len(rest):
        low = (rest & np.uint64(127)).astype(np.uint8)
        rest = rest >> np.uint64(7)
        more = rest > 0
        out[places] = low | (more.astype(np.uint8) << 7)
        places, rest = places[more] + 1, rest[more]
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(parts, starts), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts from 0 as packed running sums (each count raised by one); sums of such lists from
    several tasks are lists of summed counts."""
    return packed(np.cumsum(counts.astype(np.uint64) + np.uint64(1)))
