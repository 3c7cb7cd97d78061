"""Which of many values stand in texts: windows of bytes, hashed for all positions at once.

A window's hash is a difference of running sums, so every length costs one pass over arrays.  Bitmaps of the values'
hashes say which windows may be values; only these leave the task, and whoever compares them with the values decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Values of so many bytes and more are looked for only where their first bytes are those of a value.
HEAD = 8
SLICE = 1 << 18
BITS = 26
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(sums: np.ndarray, length: int) -> np.ndarray:
    """Places in a bitmap, from the sums over windows moved to one origin and their length."""
    x = sums ^ np.uint64(length * 0xC4CEB9FE1A85EC53 % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - BITS)


def _sums(part: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=out[1:])
    return out


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binaries; null counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)


def value_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of values (binary, not null) in the bitmaps, from 1: kind 0 for whole values, 1 for heads."""
    for batch in batches:
        data, offsets = _buffers(batch.column(0))
        out = {0: [], 1: []}
        lengths = np.diff(offsets)
        for length in np.unique(lengths):
            every, powers = offsets[:-1][lengths == length], _powers(_BASE, max(int(length), 1))
            for starts in np.array_split(every, 1 + len(every) * length // SLICE):
                rows = data[starts[:, None] + np.arange(length)].astype(np.uint64) + np.uint64(1)
                for kind, n in ((0, length), (1, HEAD)):
                    if kind <= (length >= HEAD):
                        out[kind].append(_places((rows[:, :n] * powers[:n]).sum(axis=1, dtype=np.uint64), int(n)))
        for kind, found in out.items():
            if found:
                places = np.unique(np.concatenate(found)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), kind, np.int32)), pa.array(places)], ["kind", "place"])


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _found(data: np.ndarray, offsets: np.ndarray, lengths: list[int], values: np.ndarray, heads: np.ndarray) -> set[tuple[int, bytes]]:
    """(row, window) for every window of one of the lengths that the bitmaps allow, once each."""
    found: set[tuple[int, bytes]] = set()
    longest, low, high = max(lengths, default=0), int(offsets[0]), int(offsets[-1])
    powers = _powers(_BASE, min(SLICE, high - low) + longest + 1)
    back = _powers(_INVERSE, min(SLICE, high - low) + 1)
    for base in range(low, high, SLICE):
        part = data[base : min(base + SLICE + longest, high)]
        sums = _sums(part, powers)
        every = np.arange(min(SLICE, high - base))
        row = np.searchsorted(offsets, every + base, "right") - 1
        room = offsets[row + 1] - base - every  # bytes to the end of the row's text

        def matching(at: np.ndarray, length: int, bitmap: np.ndarray) -> np.ndarray:
            at = at[room[at] >= length]
            return at[_has(bitmap, _places((sums[at + length] - sums[at]) * back[at], length))]

        begun = matching(every, HEAD, heads) if longest >= HEAD else every[:0]
        for length in lengths:
            for at in matching(begun if length >= HEAD else every, length, values) if length else ():
                found.add((int(row[at]), part[at : at + length].tobytes()))
    return found


def candidates(batches: Iterator[pa.RecordBatch], lengths: list[int], bitmaps) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text (binary), once for each window that may be a value, which takes its place."""
    values, heads = (np.frombuffer(b, np.uint8) for b in bitmaps.value)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = _found(*_buffers(texts), lengths, values, heads)
        if 0 in lengths:
            found |= {(i, b"") for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)).tolist()}
        if found:
            rows, windows = zip(*sorted(found))
            kept = [batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(windows, pa.binary())], batch.schema.names)
