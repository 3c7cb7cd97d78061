"""Sliding-window admission: at most so many admitted requests per key in any window.

Whether a request is admitted depends on the admitted ones before it, which looks like one
long chain per key.  It is not: a request with fewer than ``max_requests`` requests of any
kind in its window is admitted whatever happened.  Only stretches of time with more than that
need the chain, and a stretch ends after one window without such requests.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed_values as fv

_HELPERS = ["_at", "_bucket", "_island", "_context"]


def retry_after(oldest: int, now: int, window: int) -> int:
    """Whole seconds until the oldest admitted request (times in microseconds) lets one in."""
    return max(1, (oldest + window - now) // 1_000_000 + 1)


def admit_in_order(
    times: list[int], admitted: deque[int], max_requests: int, window: int
) -> list[tuple[bool, int]]:
    """Decide requests in time order; ``admitted`` holds at most ``max_requests`` times."""
    out = []
    for now in times:
        while admitted and admitted[0] < now - window:
            admitted.popleft()
        if len(admitted) < max_requests:
            admitted.append(now)
            out.append((True, 0))
        else:
            out.append((False, retry_after(admitted[0], now, window)))
    return out


def _contested(rows: DataFrame, key: str, order: str, max_requests: int, window: int) -> DataFrame:
    """The (key, bucket) pairs with a request that history decides.

    Buckets are one window long, so a request's window reaches into the bucket before it at
    most: each row is also shown to the next bucket.  This spreads a hot key over time.
    """
    shown = rows.select(
        key, order, "_at", "_bucket",
        F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)).alias("_seen_in"),
    )
    before = Window.partitionBy(key, "_seen_in").orderBy("_at", order)
    full = F.lag("_at", max_requests).over(before) >= F.col("_at") - window
    return (
        shown.withColumn("_full", full)
        .where(F.col("_full") & (F.col("_bucket") == F.col("_seen_in")))
        .select(key, "_bucket")
        .distinct()
    )


def _islands(contested: DataFrame, key: str) -> DataFrame:
    """Neighbouring contested buckets as one island, and the quiet bucket before it.

    There is one row per key and window of time, however many requests that holds.
    """
    by_time = Window.partitionBy(key).orderBy("_bucket")
    grouped = contested.withColumn("_gap", F.col("_bucket") - F.row_number().over(by_time))
    started = grouped.withColumn(
        "_island", F.min("_bucket").over(Window.partitionBy(key, "_gap"))
    ).drop("_gap")
    context = started.select(key, "_island").distinct().withColumn("_bucket", F.col("_island") - 1)
    return started.withColumn("_context", F.lit(False)).unionByName(
        context.withColumn("_context", F.lit(True))
    )


def admit(
    requests: DataFrame,
    key: str = "key",
    time: str = "ts",
    order: str = "request_id",
    max_requests: int = fv.RATE_MAX_REQUESTS,
    window_seconds: int = fv.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Add ``admitted`` and ``retry_after`` (seconds, 0 if admitted) to every request.

    ``order`` breaks ties of time; requests without a key are not limited.  A stretch of overload
    of one key is decided in one task, from a sorted stream, with the last admitted times as its
    only state.
    """
    if max_requests <= 0 or window_seconds <= 0:
        raise ValueError("max_requests and window_seconds must be positive")
    window = window_seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = requests.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / window))
    named = rows.where(F.col(key).isNotNull())
    islands = _islands(_contested(named, key, order, max_requests, window), key)
    placed = rows.join(islands, [key, "_bucket"], "left")

    decided = [F.lit(True).alias("admitted"), F.lit(0).alias("retry_after")]
    free = placed.where(F.col("_island").isNull() | F.col("_context"))
    chained = (
        placed.where(F.col("_island").isNotNull())
        .repartition(key, "_island")
        .sortWithinPartitions(key, "_island", "_at", order)
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()
        for batch in batches:
            marks = []
            for group, part in batch.groupby([key, "_island"], sort=False, dropna=False):
                if group != current:
                    current, admitted = group, deque()
                marks += admit_in_order(part["_at"].tolist(), admitted, max_requests, window)
            batch["admitted"], batch["retry_after"] = zip(*marks) if marks else ([], [])
            yield batch[~batch["_context"].astype(bool)].drop(columns=_HELPERS)

    schema = requests.withColumns({"admitted": F.lit(True), "retry_after": F.lit(0)}).schema
    return free.select(*requests.columns, *decided).unionByName(chained.mapInPandas(chain, schema))
