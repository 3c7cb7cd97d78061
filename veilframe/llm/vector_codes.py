"""Vector compression to four code bytes; nearest entries by slicing and intersecting bitmasks.

Components become whole numbers, a vector's four parts are coded by the nearest entries of four codebooks, which are
refined in a few rounds of assignment and averaging.  All arithmetic is on whole numbers, so results do not depend
on the order of sums.

Nearest entry: for each dimension of a part the codebook's coordinates are sorted, and for each place in that order there is
a mask of the entries before it, in uint64 words.  A part and a radius select a range of places per dimension; the
two prefix masks at its ends, XORed, are the entries of the slice, and the slices' masks ANDed are the entries of the
box around the part.  Only these are measured.  If the nearest of them is within the radius, it is the nearest of
all, as entries outside the box are farther.  Else the radius becomes that distance, or twice itself where the box was
empty, and the row tries again.  The initial radius is the median distance between entries and their nearest
neighbours.

Scale: a round is one pass over the stored whole-number vectors; a task sends one count and sum per entry, which are
added up by group; only codebooks (at most 4 * 256 entries) reach the driver and the tasks.  Vectors are never
shuffled.  Errors are summed by label before the shuffle and joined back, so a label of a third of all rows moves as
one row per task.

Cases: vectors that are null, hold null or non-finite components, or components whose whole number needs more than 62 bits
take no part; so do vectors of another length than the first (by vec_id) whose length is a positive
multiple of 4.  Rows with equal vec_id are all coded, for the first codebooks in order of their vectors; a null vec_id comes last.
Fewer than 256 vectors give as many entries.  Errors beyond 64 bits are given as the largest long.  An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import only, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MEASURED = 1 << 22
MOST = (1 << 63) - 1
WORD_BITS = 64


class Slices:
    """A codebook with the sorted coordinates and prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, self.width = entries.shape
        self.words = -(-n // WORD_BITS)
        bit = np.zeros((n, self.words), np.uint64)
        bit[np.arange(n), np.arange(n) // WORD_BITS] = np.uint64(1) << (np.arange(n) % WORD_BITS).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.before = np.zeros((self.width, n + 1, self.words), np.uint64)
        for d in range(self.width):
            self.before[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        self.first_radius = self._first_radius()

    def _first_radius(self) -> int:
        apart = ((self.entries[:, None, :].astype(float) - self.entries[None, :, :]) ** 2).sum(axis=2)
        apart[apart == 0] = np.inf
        nearest = apart.min(axis=1, initial=np.inf)
        nearest = nearest[np.isfinite(nearest)]
        return max(1, int(math.sqrt(np.median(nearest)))) if len(nearest) else 1

    def inside(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the boxes of these radii around the rows."""
        masks = np.full((len(rows), self.words), ~np.uint64(0))
        for d in range(self.width):
            low = np.searchsorted(self.sorted[:, d], rows[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], rows[:, d] + radius, "right")
            masks &= self.before[d, high] ^ self.before[d, low]
        return masks

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry, of equally near ones the first, and its squared distance."""
        n = len(rows)
        found, error = np.zeros(n, np.int64), np.zeros(n, rows.dtype)
        todo, radius = np.arange(n), np.full(n, self.first_radius, rows.dtype)
        if not self.width:
            return found, error
        while len(todo):
            masks = self.inside(rows[todo], radius)
            bits = np.unpackbits(masks.view(np.uint8).reshape(len(todo), -1), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gap = rows[todo[row]] - self.entries[entry]
            apart = (gap * gap).sum(axis=1)
            some, first = np.unique(row, return_index=True)
            least = np.minimum.reduceat(apart, first) if len(some) else apart
            counts = np.diff(np.append(first, len(row)))
            hits = np.flatnonzero(apart == np.repeat(least, counts)) if len(some) else first
            _, place = np.unique(row[hits], return_index=True)
            found[todo[some]], error[todo[some]] = entry[hits[place]], least
            radius = radius * 2
            sure = np.zeros(len(todo), bool)
            sure[some] = least <= (radius[some] // 2) ** 2
            radius[some] = _root(least)
            todo, radius = todo[~sure], radius[~sure]
        return found, error


def _root(squares: np.ndarray) -> np.ndarray:
    """The least whole numbers whose squares are at least these."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(s) - 1) + 1 if s else 0 for s in squares], object)
    root = np.ceil(np.sqrt(squares.astype(float))).astype(np.int64)
    root += root * root < squares
    return root


def _fits(rows: np.ndarray, books: list[Slices]) -> bool:
    """Whether distances, radii and sums of these rows stay within 64 bits."""
    top = max([int(np.abs(rows).max(initial=0)), *[int(np.abs(b.entries).max(initial=0)) for b in books]])
    return rows.shape[1] * (4 * top + 4) ** 2 < 1 << 62


def _matrices(batches: Iterator[pa.RecordBatch], width: int, *names: str) -> Iterator[tuple]:
    """Slices of rows, few enough that measuring all entries of a part stays within bounds."""
    most = max(1, MEASURED * PARTS // (ENTRIES * width))
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            some = batch.slice(i, most)
            flat = some.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(some.num_rows, width), *[some.column(n) for n in names]


def _assigned(rows: np.ndarray, books: list[Slices]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, its rows, their entries and squared distances."""
    if not _fits(rows, books):
        rows, books = rows.astype(object), [_exact(b) for b in books]
    step = rows.shape[1] // PARTS
    for p, book in enumerate(books):
        part = rows[:, p * step : (p + 1) * step]
        yield p, part, *book.nearest(part)


def _exact(book: Slices) -> Slices:
    """The same codebook in numbers of any size."""
    other = object.__new__(Slices)
    other.__dict__ = book.__dict__ | {"entries": book.entries.astype(object), "sorted": book.sorted.astype(object)}
    return other


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Per part, entry and position the count and the sum, the latter as sum // 2^32 and the rest."""
    books = [Slices(b) for b in books]
    entries, step = books[0].entries.shape
    count = np.zeros((PARTS, entries), np.int64)
    high, low = np.zeros((PARTS, entries, step), np.int64), np.zeros((PARTS, entries, step), np.int64)
    for rows, in _matrices(batches, PARTS * step):
        for p, part, entry, _ in _assigned(rows, books):
            np.add.at(count[p], entry, 1)
            np.add.at(high[p], entry, (part >> 32).astype(np.int64))
            np.add.at(low[p], entry, (part & 0xFFFFFFFF).astype(np.int64))
    p, e = np.nonzero(count)
    if len(p):
        high, low = high + (low >> 32), low & 0xFFFFFFFF
        place = np.tile(np.arange(step), len(p))
        yield pa.RecordBatch.from_pydict({
            "part": np.repeat(p, step), "entry": np.repeat(e, step), "place": place, "n": np.repeat(count[p, e], step),
            "high": high[p, e].ravel(), "low": low[p, e].ravel(),
        })


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    books = [Slices(b) for b in books]
    for rows, ids, labels in _matrices(batches, PARTS * books[0].width, "vec_id", "label"):
        found = [(entry, error) for _, _, entry, error in _assigned(rows, books)]
        codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
        errors = sum(error.astype(object) for _, error in found)
        yield pa.RecordBatch.from_arrays([
            ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array([min(int(e), MOST) for e in errors], pa.int64()),
        ], ["vec_id", "label", "code", "error"])


def _call(work, books, batches):
    return work(batches, books)


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the vectors as arrays of whole numbers, all of one length that parts divide."""
    x = F.col("vector").cast("array<double>")
    most = float(1 << 62)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < most))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    size = F.size("vector")
    fit = only(rows, vec_id=key, vector=vector, label=label).where(
        F.col("vector").isNotNull() & F.coalesce(sound, F.lit(False)) & (size > 0) & (size % PARTS == 0)
    ).select("vec_id", "label", whole.alias("vector"))
    kept = stored(fit, "vectors")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("n")).first()
    return kept.where(F.size("vector") == (first["n"] if first else 0))


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    few = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    if not few:
        return []
    return [b.copy() for b in np.split(np.array([r["vector"] for r in few], np.int64), PARTS, axis=1)]


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of its parts, unused ones as before."""
    sums = vectors.select("vector").mapInArrow(
        partial(_call, _sums, books), "part long, entry long, place long, n long, high long, low long"
    ).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    after = [b.copy() for b in books]
    for r in sums.collect():
        after[r["part"]][r["entry"], r["place"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return after


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the digest of the codebooks."""
    kept = whole_vectors(rows, key, vector, label)
    kinds = dict(kept.dtypes)
    books = first_books(kept)
    if not books:
        return kept.select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(n) for n in ("error", "label_error")],
                           F.lit("").alias("codebooks_sha256"))
    for _ in range(rounds):
        books = refined(kept, books)
    coded = stored(kept.select("vec_id", "label", "vector").mapInArrow(
        partial(_call, _codes, books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    ), "codes")
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", _long(F.col("_sum")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")
    )


def _long(whole: Column) -> Column:
    return F.least(whole, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(table(spark, folder, "embeddings"))


def _round(n: int, last: bool) -> str:
    """One assignment of SQL, with the codebooks of the round before."""
    assign = f"""near{n} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, (err, entry)) AS entry, min(err) AS err FROM (
  SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS err
  FROM parts x JOIN book{n} b ON b.part = x.part) GROUP BY vec_id, part)"""
    if last:
        return assign
    return assign + f""",
mean{n} AS (SELECT part, entry, list(floor_ ORDER BY place) AS v FROM (
  SELECT n.part, n.entry, place, CAST((sum(x.v[place]) - ((sum(x.v[place]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS floor_
  FROM near{n} n JOIN parts x ON x.vec_id = n.vec_id AND x.part = n.part, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM parts))) AS place)
  GROUP BY n.part, n.entry, place) GROUP BY part, entry),
book{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m ON m.part = b.part AND m.entry = b.entry)"""


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // {PARTS}) + 1, (part + 1) * (len(v) // {PARTS})) AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(_round(n, n == ROUNDS) for n in range(ROUNDS + 1))},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(err) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id
"""
