"""Left join of a large table with one row per key, when some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 100_000


def join_hot_keys(
    rows: DataFrame,
    per_key: DataFrame,
    *keys: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``per_key`` (unique keys) to ``rows``, hot keys spread over many tasks.

    A first pass counts rows per key, combined before the shuffle.  There are at most
    rows / hot_rows hot keys; only these are copied on the small side, once per ``hot_rows``
    of their rows, and only their rows get a random-like salt, so every other key keeps a single copy
    and no task gets much more than ``hot_rows`` rows of one key.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_spread"))
    place = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_spread", F.lit(1))).cast("int")
    salted = rows.join(hot, [*keys], "left").withColumn("_salt", place).drop("_spread")
    copies = F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1)
    copied = per_key.join(hot, [*keys], "left").withColumn("_salt", F.explode(copies))
    return salted.join(copied.drop("_spread"), [*keys, "_salt"], "left").drop("_salt")
