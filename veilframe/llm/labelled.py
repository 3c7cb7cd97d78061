"""A bounded sample of labelled documents for fitting models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import only

SAMPLE = 20_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """Labelled rows of docs outside the held-out fold, `sample` ids at most (those with the
    smallest hashes), with columns label (0 or 1) and fold.  Of several labels of an id the
    largest counts; ids without a label take no part.  The limit bounds the broadcast."""
    known = only(labels, doc_id="doc_id", label=label).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    known = known.withColumn("fold", fold(F.col("_labelled"))).where("fold <> 1")
    few = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    return docs.join(F.broadcast(few), F.col("doc_id") == F.col("_labelled")).drop("_labelled")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(hold * w * w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return w
