"""Removal of repeated passages: count-min prefilter, then exact grouping of what it lets through.

A window is `width` consecutive words of one document.  A word goes if it lies in a window whose word
sequence also starts in a document with a smaller doc_id; windows are judged on the input.

The documents are dealt by a hash of doc_id into blocks of about `block_bytes` of text, once; three
passes read that one shuffle.

1. Sketch.  Each block has a count-min sketch of its windows: `depth` rows of four cells per window
   of the whole table, counting documents.  A block touches few of the cells, so it sends them as
   sorted gaps.  Slices of the cell range are merged by adding the blocks' counts; each block gets
   back which of its cells count two or more.  The sketch is sharded, so it grows with the table and
   no task and no broadcast holds all of it.
2. Exact.  A window whose cells all count two or more may be repeated (the smallest of its cells
   overestimates its count, so none is lost).  Only these windows, once per block, go to exact
   grouping by a 128-bit key of their words; the group's smallest doc_id returns to the blocks that
   hold a larger one.
3. Removal.  Each block marks the words under those windows and hashes what is left.

A passage that every document shares arrives once per block, whatever the number of documents, so no
group has more rows than there are blocks.

Cases: null or empty text has no words and keeps the hash of the empty string; shorter texts than
`width` keep all words; repeats inside one document stay; rows with the same doc_id are judged
separately and never against each other; a null doc_id counts as larger than any other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import hashing as hs
from .common import only, table, tasks, text_buffers

NO_ID = np.iinfo(np.int64).max
CELLS = "block int, shard int, kind int, body binary"
_EMPTY = np.zeros(0, np.uint64)


def _windows(docs: pa.Table, width: int):
    """Keys (two hashes) and doc_id of every window, in order; per document its words' number."""
    data, offsets = text_buffers(docs.column("text"))
    ids = docs.column("doc_id").to_numpy()
    found, counts = [], np.zeros(len(ids), np.int64)
    for i, j in hs.pieces(offsets):
        starts, ends, n = hs.word_places(data, offsets[i : j + 1])
        counts[i:j] = n
        a, b, owner = hs.run_hashes(hs.word_hashes(data, starts, ends), n, width)
        found.append((a, b, ids[i:j][owner]))
    if not found:
        return _EMPTY, _EMPTY, np.zeros(0, np.int64), counts
    return *[np.concatenate(x) for x in zip(*found, strict=True)], counts


def _cells(a: np.ndarray, b: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each window in one row of the sketch."""
    return hs.mixed(a + np.uint64(row + 1) * b) % np.uint64(cells)


def _first_of_each(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by all the columns, and where in it a new (a, b) begins."""
    order = np.lexsort(columns[::-1])
    a, b = columns[0][order], columns[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _cut(values: np.ndarray, bound: int, shards: int) -> list[int]:
    """Ranges of sorted values by shard."""
    inner = np.searchsorted(values, np.array([bound * k // shards for k in range(1, shards)], np.uint64))
    return [0, *inner.tolist(), len(values)]


def _sketch(docs: pa.Table, width: int, depth: int, cells: int, shards: int) -> pa.Table:
    """The block's cells, by row and slice: sorted cell * 2 + (counts two or more)."""
    block = docs.column("block")[0].as_py()
    a, b, owner, _ = _windows(docs, width)
    order, new = _first_of_each(a, b, owner)
    a, b, owner = a[order], b[order], owner[order]
    new[1:] |= owner[1:] != owner[:-1]
    a, b = a[new], b[new]
    out = []
    for row in range(depth):
        cell = np.sort(_cells(a, b, row, cells))
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        places = np.flatnonzero(first)
        many = np.diff(np.append(places, len(cell))) > 1
        cell = cell[places]
        edges = _cut(cell, cells, shards)
        for s in range(shards):
            i, j = edges[s], edges[s + 1]
            if j > i:
                out.append((block, s, row, hs.packed(cell[i:j] * np.uint64(2) + many[i:j])))
    return _table(out)


def _table(rows: list) -> pa.Table:
    block, shard, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({
        "block": pa.array(block, pa.int32()), "shard": pa.array(shard, pa.int32()),
        "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary()),
    })


def _merge(part: pa.Table) -> pa.Table:
    """Add the blocks' counts of one slice of one row; each block's cells with two or more."""
    shard, row = part.column("shard")[0].as_py(), part.column("kind")[0].as_py()
    blocks = part.column("block").to_pylist()
    sent = [hs.unpacked(x.as_py()) for x in part.column("body")]
    marks = np.sort(np.concatenate([x >> np.uint64(1) for x in sent] + [x[(x & np.uint64(1)) > 0] >> np.uint64(1) for x in sent]))
    again = np.unique(marks[1:][marks[1:] == marks[:-1]])
    out = []
    for block, x in zip(blocks, sent, strict=True):
        cell = x >> np.uint64(1)
        hit = cell[_among(cell, again)]
        if len(hit):
            out.append((block, shard, row, hs.packed(hit)))
    return _table(out)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _suspects(docs: pa.Table, marks: pa.Table, width: int, depth: int, cells: int, shards: int) -> pa.Table:
    """Windows all of whose cells count two or more, once per block with the smallest doc_id and
    whether the block holds a larger one: key in order, second hash, smallest doc_id, flag."""
    if not docs.num_rows or not marks.num_rows:
        return _table([])
    block = docs.column("block")[0].as_py()
    a, b, owner, _ = _windows(docs, width)
    kinds = marks.column("kind").to_numpy()
    for row in range(depth):
        known = [hs.unpacked(marks.column("body")[int(i)].as_py()) for i in np.flatnonzero(kinds == row)]
        hit = _among(_cells(a, b, row, cells), np.sort(np.concatenate(known)) if known else _EMPTY)
        a, b, owner = a[hit], b[hit], owner[hit]
    order, new = _first_of_each(a, b, owner)
    a, b, owner = a[order], b[order], owner[order]
    places = np.flatnonzero(new)
    more = owner[np.append(places[1:], len(owner)) - 1] > owner[places] if len(places) else np.zeros(0, bool)
    a, b, owner = a[places], b[places], owner[places]
    edges = _cut(a, 1 << 64, shards)
    out = []
    for s in range(shards):
        i, j = edges[s], edges[s + 1]
        if j > i:
            body = b[i:j].tobytes() + owner[i:j].tobytes() + np.packbits(more[i:j]).tobytes()
            out.append((block, s, int(j - i), body + hs.packed(a[i:j])))
    return _table(out)


def _read(n: int, body: bytes):
    low = 16 * n + (n + 7) // 8
    b, owner = np.frombuffer(body, np.uint64, n), np.frombuffer(body, np.int64, n, 8 * n)
    more = np.unpackbits(np.frombuffer(body, np.uint8, (n + 7) // 8, 16 * n), count=n).astype(bool)
    return hs.unpacked(body[low:]), b, owner, more


def _group(part: pa.Table) -> pa.Table:
    """The smallest doc_id of each key; back to the blocks that hold a larger one."""
    shard = part.column("shard")[0].as_py()
    blocks, sizes = part.column("block").to_pylist(), part.column("kind").to_pylist()
    read = [_read(n, x.as_py()) for n, x in zip(sizes, part.column("body"), strict=True)]
    a, b, owner, more = [np.concatenate(x) for x in zip(*read, strict=True)]
    order, new = _first_of_each(a, b, owner)
    least = np.empty(len(a), np.int64)
    least[order] = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    wanted = more | (owner > least)
    out, i = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        pick = i + np.flatnonzero(wanted[i : i + n])
        if len(pick):
            out.append((block, shard, len(pick), b[pick].tobytes() + least[pick].tobytes() + hs.packed(a[pick])))
        i += n
    return _table(out)


def _remove(docs: pa.Table, groups: pa.Table, width: int) -> pa.Table:
    """Words removed and the hash of the kept ones, per document of a block."""
    keys = []
    for n, x in zip(groups.column("kind").to_pylist(), groups.column("body"), strict=True):
        body = x.as_py()
        keys.append((hs.unpacked(body[16 * n :]), np.frombuffer(body, np.uint64, n), np.frombuffer(body, np.int64, n, 8 * n)))
    data, offsets = text_buffers(docs.column("text"))
    ids = docs.column("doc_id").to_numpy()
    if keys:
        ka, kb, least = [np.concatenate(x) for x in zip(*keys, strict=True)]
        order = np.lexsort((kb, ka))
        ka, kb, least = ka[order], kb[order], least[order]
    total, removed, digests = [], [], []
    for i, j in hs.pieces(offsets):
        starts, ends, counts = hs.word_places(data, offsets[i : j + 1])
        gone = np.zeros(len(starts) + 1, np.int64)
        if keys and len(starts) >= width:
            a, b, owner = hs.run_hashes(hs.word_hashes(data, starts, ends), counts, width)
            firsts = np.concatenate([np.arange(n - width + 1) + c for n, c in zip(counts, np.cumsum(counts) - counts, strict=True) if n >= width] or [np.zeros(0, np.int64)])
            at = np.searchsorted(ka, a)
            hit = np.zeros(len(a), bool)
            while True:  # the few keys that share a first hash
                at_in = np.minimum(at, len(ka) - 1)
                same = (at < len(ka)) & (ka[at_in] == a)
                hit |= same & (kb[at_in] == b) & (least[at_in] < ids[i:j][owner])
                if not (same & (kb[at_in] != b)).any():
                    break
                at = at + 1
            np.add.at(gone, firsts[hit], 1)
            np.subtract.at(gone, firsts[hit] + width, 1)
        covered = np.cumsum(gone[:-1]) > 0
        place = 0
        for d in range(i, j):
            n = int(counts[d - i])
            words = data[offsets[d] : offsets[d + 1]].tobytes().split()
            out = covered[place : place + n]
            lost = int(out.sum())
            if lost:
                words = [words[k] for k in np.flatnonzero(~out)]
            total.append(n)
            removed.append(lost)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            place += n
    return pa.table({
        "doc_id": pa.array([None if x == NO_ID else int(x) for x in ids], pa.int64()), "n_words": pa.array(total, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
    })


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, depth: int = 2,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=key, text=text)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(tasks(spark), size // block_bytes + 1)
    cells = max(1 << 16, 4 * (size // 6))
    dealt = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text",
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("block"),
    )
    how = {"width": width, "depth": depth, "cells": cells, "shards": shards}
    blocks = dealt.groupBy("block")
    sketch = blocks.applyInArrow(partial(_call, _sketch, how), CELLS)
    marks = sketch.groupBy("shard", "kind").applyInArrow(_merge, CELLS)
    suspects = blocks.cogroup(marks.groupBy("block")).applyInArrow(partial(_call2, _suspects, how), CELLS)
    groups = suspects.groupBy("shard").applyInArrow(_group, CELLS)
    return blocks.cogroup(groups.groupBy("block")).applyInArrow(
        partial(_call2, _remove, {"width": width}), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def _call(work, how, part):
    return work(part, **how)


def _call2(work, how, left, right):
    return work(left, right, **how)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) p, w FROM t WHERE len(w) >= 13),
k AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY list_slice(w, p, p + 12)) < doc_id AS hit FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) p FROM k WHERE hit),
g AS (SELECT doc_id, list(p) ps, count(*) n FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n, 0) n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""
