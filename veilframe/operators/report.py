"""Counts and reports over spans and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv, text as tx


def type_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type").agg(F.count("*").alias("n"))


def _share(n: str) -> Column:
    """Percent of all; the window sees one row per type or source only."""
    return F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy())


def type_stats(spans: DataFrame) -> DataFrame:
    """Number, share and confidence range per type."""
    counted = spans.groupBy("type").agg(
        F.count("*").alias("n"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.avg("confidence").alias("avg_confidence"),
    )
    return counted.withColumn("percent", _share("n")).orderBy("type")


def source_stats(spans: DataFrame) -> DataFrame:
    """Number and share per recogniser; spans without one count as found by rule."""
    counted = spans.groupBy(F.coalesce("source", F.lit("rule")).alias("source")).agg(
        F.count("*").alias("n")
    )
    return counted.withColumn("percent", _share("n")).orderBy(F.desc("n"), "source")


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows of a report with their ``place`` from 1: files by path, types by name.  For reports, which have one row per
    file, type or source; the numbering is one task's work."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def entity_type_counts(entities: Column) -> Column:
    """Entities of one document as an array of (type, n), by type."""
    types = F.transform(entities, lambda e: e.getField("type"))
    return F.transform(
        F.array_sort(F.array_distinct(types)),
        lambda t: F.struct(
            t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")
        ),
    )


def batch_report(documents: DataFrame, by: str = "source", first: str | None = None) -> DataFrame:
    """Per file or source: documents, entities and a summary by type.  Where a document has several rows, ``first`` marks
    the one that counts as the document.

    Counting starts per (source, type), combined before the shuffle, so a source that holds
    most documents is no more than a few dozen rows when the summary is put together.
    """
    itself = F.array(F.lit(None).cast("string"))
    if first:
        itself = F.when(F.col(first), itself).otherwise(F.array().cast("array<string>"))
    typed = documents.select(
        by, F.explode(F.concat(itself, F.transform("entities", lambda e: e.getField("type")))).alias("type")
    )
    counted = typed.groupBy(by, "type").agg(F.count("*").alias("n"))
    # The null type stands for the document itself.
    pairs = F.array_sort(
        F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n")))
    )
    return counted.groupBy(by).agg(
        F.sum(F.when(F.col("type").isNull(), F.col("n"))).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("entities"),
        F.array_join(
            F.transform(
                pairs,
                lambda p: F.concat(p.getField("type"), F.lit(":"), p.getField("n").cast("string")),
            ),
            ", ",
        ).alias("summary"),
    )


def dry_run(spans: DataFrame, *keep: str) -> DataFrame:
    """What would be replaced, with the value as shown in reports."""
    return spans.select(
        *keep, "value", "type", tx.rounded(F.col("confidence"), 3).alias("confidence"),
        "source", "start", "end", tx.truncated(F.col("value"), 60).alias("shown"),
    )


def entity_payload(entities: Column, include_values: bool = False) -> Column:
    """The entities as they may leave the system: values only when asked for."""

    def item(e: Column) -> Column:
        fields = [
            e.getField("type").alias("type"),
            tx.rounded(e.getField("confidence"), 3).alias("confidence"),
            e.getField("source").alias("source"),
            e.getField("start").alias("start"),
            e.getField("end").alias("end"),
        ]
        return F.struct(*fields, *([e.getField("value").alias("value")] if include_values else []))

    return F.transform(entities, item)


def silent_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents long enough to expect something in which nothing was found."""
    return documents.where(tx.silent(F.col(text), F.size("entities")))


def validity(documents: DataFrame, *by: str) -> DataFrame:
    """Valid and invalid texts, in all or per group."""
    return documents.groupBy(*by).agg(
        F.count_if(F.col("validation.is_valid")).alias("valid"),
        F.count_if(~F.col("validation.is_valid")).alias("invalid"),
    )


def size_guard(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the reason why a text is refused, null when it is within the limits."""
    length = F.length(text)
    reason = F.when(F.coalesce(length, F.lit(0)) < 1, "empty").when(
        ~tx.within_limits(F.col(text)), "too long"
    )
    return documents.withColumn("refused", reason)


def mapping_guard(mapping: DataFrame, *scope: str) -> DataFrame:
    """Scopes whose mapping has more entries than a client may send, with their number."""
    counted = mapping.groupBy(*scope).agg(F.count("*").alias("entries"))
    return counted.where(F.col("entries") > fv.MAX_MAPPING_ENTRIES)
