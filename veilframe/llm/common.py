"""Shared helpers: tables, the cluster's shared folder, stored intermediate tables."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a session on one machine gets a folder of its own (and keeps
    it for later calls); on a cluster that would lose data, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder once and read them back: cuts lineage, survives the loss
    of executors, and gives Spark the true size of the table for its choice of joins."""
    folder = shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(rows: DataFrame, **names: str) -> DataFrame:
    """Just the named columns, under fixed names, so that further columns cannot clash."""
    return rows.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()])


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def packed(rows: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as a struct `row`, and further columns, whose names cannot clash with those in it."""
    return rows.select(F.struct(*map(named, rows.columns)).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
