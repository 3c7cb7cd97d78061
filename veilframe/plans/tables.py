"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(rows: DataFrame, each: int) -> int:
    """How many tasks get about ``each`` rows, one per core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def spread(rows: DataFrame, each: int | None = None) -> DataFrame:
    """Deal rows out when there are fewer splits than cores, or than tasks of ``each`` rows.

    A scan of many files has enough splits and is left alone, without a shuffle.  A small
    table in one file would keep a single core busy with all of the pattern matching.  Where texts are made of
    narrow rows, a split of a file holds hours of work: there ``each`` says how many rows are enough for a task.
    """
    wanted = parts(rows, each) if each else rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files.

    The last letter is a pattern: a plain path of a stream must be a folder, a pattern may also fit a single file.
    """
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    wanted = columns or ("doc_id", "text")
    return spread(table(spark, folder, "documents").select(*wanted))
