"""Exact top-k inner products by distributed histogram selection.

Every component x becomes floor(1024 * x); scores are integer inner products.  All candidates are
scored against all queries, block by block of queries, in a few rounds.  In each round every task
counts its scores in the bins of a query's current interval and sends the highest bins down to its own
k-th score (lower ones cannot hold the k-th best of all).  Summed, the counts show in which bin the
global k-th score lies; the next round divides that bin, until a bin is one value wide.  A last round
keeps the scores above the k-th and, of those equal to it, the k smallest vec_ids of each task; the
order (score down, vec_id up) then decides.

The queries with their intervals are a table in the shared folder that tasks read in blocks, so neither
the driver nor a task holds all of them; a task's memory is a block of queries times a slice of
candidates.

Cases: vectors null or with null, NaN or infinite components take no part; a vector is scored only
against queries of its own length; an empty vector scores 0 against others; of several rows with one
vec_id the smallest vector (by comparison of arrays) counts; a null vec_id takes no part; fewer than
k candidates give all; no queries or an empty table give an empty result; a score beyond 64 bits is an
error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import only, shared_folder, stored, table

BINS = 1024
QUERY_BLOCK = 512
SLICE = 4096
EXACT = float(1 << 53)


def vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id and whole-number vectors as arrays of long."""
    x = F.col("vector").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    valid = only(rows, vec_id=key, vector=vector).where(F.coalesce(sound, F.lit(False)))
    return valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_ids and vectors of equal length, a slice at a time."""
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector")
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for i in range(0, len(rows), SLICE):
            some = rows[i : i + SLICE]
            yield ids[some], values[offsets[some][:, None] + np.arange(size)].reshape(len(some), size)


def _query_blocks(path: str) -> Iterator[dict]:
    files, root = fs.FileSystem.from_uri(path)
    scanner = ds.dataset(root, filesystem=files, format="parquet").scanner(batch_size=QUERY_BLOCK, batch_readahead=1, fragment_readahead=1)
    for batch in scanner.to_batches():
        more = [n for n in batch.schema.names if n not in ("vec_id", "vector")]
        names = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in more}
        keys = batch.column("vec_id").to_numpy(zero_copy_only=False)
        sizes = np.diff(batch.column("vector").offsets.to_numpy())
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            picked = batch.take(pa.array(rows)).column("vector").values.to_numpy(zero_copy_only=False)
            yield {"vec_id": keys[rows], "matrix": picked.reshape(len(rows), size)} | {n: v[rows] for n, v in names.items()}


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    top = float(np.abs(queries.astype(float)).max()) * float(np.abs(candidates.astype(float)).max()) * queries.shape[1]
    if top < EXACT:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    if top >= 2.0**63:
        whole = queries.astype(object) @ candidates.astype(object).T
        if max(abs(int(v)) for v in whole.ravel()) >= 1 << 63:
            raise OverflowError("an inner product does not fit in 64 bits")
        return whole.astype(np.int64)
    return queries @ candidates.T


def _pairs(batches, path: str):
    """Blocks of queries with the scores of a task's candidates."""
    for batch in batches:
        for ids, matrix in _matrices(batch):
            for block in _query_blocks(path):
                if block["matrix"].shape[1] == matrix.shape[1]:
                    yield block, ids, _scores(block["matrix"], matrix), block["vec_id"][:, None] != ids[None, :]


def _extremes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Per query the lowest and highest score and the number of candidates of a slice."""
    for block, _, scores, other in _pairs(batches, path):
        n = other.sum(axis=1)
        some = n > 0
        low = np.where(other, scores, np.iinfo(np.int64).max).min(axis=1)
        high = np.where(other, scores, np.iinfo(np.int64).min).max(axis=1)
        yield pa.RecordBatch.from_pydict({"vec_id": block["vec_id"][some], "low": low[some], "high": high[some], "n": n[some].astype(np.int64)})


def _histograms(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """Counts of scores in the bins of each query's interval, highest bins first."""
    for block, _, scores, other in _pairs(batches, path):
        low, width, need = block["low"], block["width"], np.maximum(block["need"], 1)
        place = (scores - low[:, None]) // width[:, None]
        inside = other & (scores >= low[:, None]) & (scores < block["stop"][:, None])
        row, column = np.nonzero(inside)
        counts = np.bincount(row * BINS + place[row, column], minlength=len(low) * BINS).reshape(len(low), BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        row, bin_ = np.nonzero((counts > 0) & (above < need[:, None]))
        if len(row):
            yield pa.RecordBatch.from_pydict({"vec_id": block["vec_id"][row], "bin": bin_.astype(np.int64), "n": counts[row, bin_].astype(np.int64)})


def _winners(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """Scores above the k-th, and of those equal to it the smallest vec_ids."""
    for block, ids, scores, other in _pairs(batches, path):
        order = np.argsort(ids, kind="stable")
        ids, scores, other = ids[order], scores[:, order], other[:, order]
        kth = block["low"][:, None]
        equal = other & (scores == kth)
        equal &= np.cumsum(equal, axis=1) <= k
        row, column = np.nonzero((other & (scores > kth)) | equal)
        if len(row):
            yield pa.RecordBatch.from_pydict({"query_id": block["vec_id"][row], "vec_id": ids[column], "score": scores[row, column]})


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id, score; is_query is a condition on the column vec_id."""
    spark = rows.sparkSession
    every = stored(vectors(rows, key, vector, scale), "vectors")

    def written(queries: DataFrame) -> str:
        path = shared_folder(spark, "queries")
        queries.write.parquet(path)
        return path

    def over_all(work, schema: str, path: str, **how) -> DataFrame:
        return every.mapInArrow(partial(_call, work, dict(how, path=path)), schema)

    queries = every.where(is_query)
    path = written(queries)
    seen = over_all(_extremes, "vec_id long, low long, high long, n long", path).groupBy("vec_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    )
    span = (F.col("high") - F.col("low")).cast("decimal(38,0)")
    state = stored(
        queries.join(seen, "vec_id").select(
            "vec_id", "vector", "low", (F.col("high") + 1).alias("stop"), F.least("n", F.lit(k)).cast("long").alias("need"),
            (F.floor(span / BINS) + 1).cast("long").alias("width"), F.lit(False).alias("done"),
        ), "bounds",
    )
    while True:
        path = written(state.drop("done"))
        if (widest := state.where("not done").agg(F.max("width").alias("w")).first()["w"]) is None:
            break
        counts = over_all(_histograms, "vec_id long, bin long, n long", path, k=k).groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        here = counts.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0))).join(
            state.select("vec_id", "need"), "vec_id"
        ).where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
        new_low = F.col("low") + F.col("bin") * F.col("width")
        state = stored(
            state.join(here.select("vec_id", "bin", "above"), "vec_id").select(
                "vec_id", "vector", new_low.alias("low"), F.least("stop", new_low + F.col("width")).alias("stop"),
                (F.col("need") - F.col("above")).cast("long").alias("need"),
                F.greatest(F.lit(1), F.ceil(F.col("width") / BINS)).cast("long").alias("width"),
                (F.col("width") == 1).alias("done"),
            ), "bounds",
        )
        if widest == 1:
            path = written(state.drop("done"))
            break
    found = over_all(_winners, "query_id long, vec_id long, score long", path, k=k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _call(work, how, batches):
    return work(batches, **how)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) "rank", vec_id, score
FROM s QUALIFY "rank" <= 10
"""
