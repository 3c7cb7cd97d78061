"""Connected components of a table of links, by alternating large and small stars.

Each round joins every link with the smallest neighbour of its ends and stores the result in the shared
folder.  Neighbours are reduced to their minimum before the shuffle, and the joins back are plain
equi-joins on single keys, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest neighbour of their node."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours and the node itself move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link; columns a and b, no nulls."""
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = stored(_small(_large(now)), "links")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
