"""Exact dedup by content-defined chunk recipes; DataFrame functions only.

A normalised text (white space 0x20, 0x09-0x0D deleted, null as empty) is cut at places that its
content decides, so that an insertion moves only the cuts near it.  A chunk's identifier is its
SHA-256, verified: distinct chunk contents are grouped by their content and no two of them may share
an identifier.  A document is then an ordered list of identifiers, its recipe, and equal texts are
equal recipes.  Chunk contents cross the network once, for the verification, and combine before the
shuffle; recipes, a few bytes per hundred of text, are all that is grouped and joined.

Cuts come after three letters of given classes, 512 characters at least and 8,192 at most from the
last one; text without such letters is cut at 8,192.  Where the cuts lie decides how much is shared,
never the result.

Cases: empty texts are equal to each other; a null doc_id stays a row and sorts last among equals;
repeated rows count each, and one of them stays if their text does; an empty table gives an empty result; other
columns, whatever their names, are kept by `deduplicated` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WHITE, only, packed, sha256_of, stored, table, unpacked

CHUNK = r"(?s).{512,8191}?(?:[aeou][lnrst][aehi]|\z)|.{1,8192}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = only(docs, doc_id=key, text=text)
    whole = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.length(whole).cast("long").alias("n_chars"), F.regexp_replace(whole, WHITE, "").alias("norm"))


def _identifiers(norm: Column) -> Column:
    return F.transform(chunks(norm), lambda c: F.unhex(sha256_of(c)))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """place (a number for each row), doc_id, n_chars of the original, text_sha256 of the normalised text, recipe."""
    rows = normalised(docs, key, text)
    return rows.select(
        F.monotonically_increasing_id().alias("place"), "doc_id", "n_chars", sha256_of(F.col("norm")).alias("text_sha256"), _identifiers(F.col("norm")).alias("recipe")
    )


def chunk_store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every different chunk once: its identifier and how many contents claim it (always 1)."""
    contents = normalised(docs, key, text).select(F.explode(chunks(F.col("norm"))).alias("content")).distinct()
    return contents.groupBy(F.unhex(sha256_of(F.col("content"))).alias("identifier")).agg(F.count("*").alias("contents"))


def _best(listed: DataFrame, contents: DataFrame) -> DataFrame:
    """Of rows place, doc_id, n_chars, recipe: per recipe the best row and group_size.  Fails if two chunk contents
    share an identifier."""
    doubtful = contents.where("contents > 1").agg(F.count("*").alias("n")).scalar()
    checked = F.assert_true(doubtful == 0, F.lit("two chunk contents share an identifier"))
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))
    groups = listed.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return groups.select("recipe", "best.doc_id", "best.place", "group_size", checked.alias("checked")).where(F.col("checked").isNull()).drop("checked")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts one row stays: the one with the most characters in the original, then the smallest
    doc_id, nulls last, then any one.
    """
    listed = stored(recipes(docs, key, text), "recipes")
    groups = _best(listed, chunk_store(docs, key, text)).withColumnsRenamed({"doc_id": "keep_id", "place": "keep_place"})
    return listed.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group of equal texts that stays, with all its columns.  Rows are told apart by a number in
    a stored copy."""
    rows = stored(packed(docs, place=F.monotonically_increasing_id()), "rows")
    texts = rows.select("place", F.col("row").getField(key).alias("doc_id"), F.coalesce(F.col("row").getField(text), F.lit("")).alias("text"))
    listed = texts.select("place", "doc_id", F.length("text").alias("n_chars"), _identifiers(F.regexp_replace("text", WHITE, "")).alias("recipe"))
    keep = _best(listed, chunk_store(texts))
    return unpacked(rows.join(keep.select("place"), "place", "left_semi"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) keep_id,
  row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) place,
  count(*) OVER (PARTITION BY norm) group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
