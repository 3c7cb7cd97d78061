"""Writing anonymised texts and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def output_name(source: Column) -> Column:
    """``<stem>_anon.txt`` for a file path.

    Files that differ only in suffix get the same name; the rows keep their source.
    """
    name = F.regexp_extract(source, r"([^/]+)\z", 1)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", ""), F.lit("_anon.txt"))


def write_anonymised(documents: DataFrame, path: str, as_text: bool = False) -> None:
    """Anonymised texts, as one table or, for small batches, as one text folder per file."""
    rows = documents.select(
        "source", output_name(F.col("source")).alias("file"), "anonymized_text"
    )
    if as_text:
        texts = rows.select("file", "anonymized_text")
        texts.write.mode("overwrite").partitionBy("file").text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object per row; null fields stay visible."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(documents: DataFrame, path: str) -> None:
    """Anonymised texts with a file name each, and last a manifest of (source, file, digest).

    Sources that differ only in folder or suffix get numbered names, in order of source.  A reader that finds no manifest
    has found a write that did not end.
    """
    named = documents.select("source", output_name(F.col("source")).alias("file"), "anonymized_text")
    place = F.row_number().over(Window.partitionBy("file").orderBy("source"))
    again = F.regexp_replace("file", r"\.txt\z", "")
    numbered = named.withColumn("_place", place).select(
        "source", F.when(F.col("_place") == 1, F.col("file")).otherwise(F.concat(again, F.lit("_"), "_place", F.lit(".txt"))).alias("file"), "anonymized_text"
    )
    numbered.write.mode("overwrite").parquet(f"{path}/texts")
    spark = documents.sparkSession
    texts = spark.read.schema(numbered.schema).parquet(f"{path}/texts")
    texts.select("source", "file", _digest("anonymized_text").alias("digest")).write.mode("overwrite").parquet(f"{path}/manifest")


def _digest(text: str) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """source, file, anonymized_text and ``ok``: whether the text is the one in the manifest."""
    texts = spark.read.parquet(f"{path}/texts")
    listed = spark.read.parquet(f"{path}/manifest").select(F.col("source").alias("_source"), F.col("file").alias("_file"), "digest")
    both = texts.join(listed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("file") == F.col("_file")), "full")
    ok = F.coalesce(F.col("digest") == _digest("anonymized_text"), F.lit(False)) & F.col("file").isNotNull()
    return both.select(F.coalesce("source", "_source").alias("source"), F.coalesce("file", "_file").alias("file"), "anonymized_text", ok.alias("ok"))
