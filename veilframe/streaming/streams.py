"""The same work on streams: anonymising, admission and session expiry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..operators.admission import admit
from ..operators.outside import detect_any
from ..operators.tokens import anonymise
from ..operators.validate import check_anonymised


def anonymise_stream(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Tokens start anew in every document, so each row stands alone: no state, no shuffle.

    A file is read by one task.  Where micro-batches are a few large files, ``tasks`` deals their rows out first.
    """
    documents = documents.repartition(tasks) if tasks else documents
    return check_anonymised(anonymise(detect_any(documents, text, threshold, types), text))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there, exactly once, into Parquet."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def admit_stream(
    requests: DataFrame,
    path: str,
    state: str,
    key: str = "key",
    time: str = "ts",
    order: str = "request_id",
    max_requests: int = fv.RATE_MAX_REQUESTS,
    window_seconds: int = fv.RATE_WINDOW_SECONDS,
    keep_seconds: int = 86_400,
) -> StreamingQuery:
    """Decide requests as they arrive; every one gets a verdict, late ones too.

    Each micro-batch goes through the batch operator together with the admitted requests of the
    last window of its keys, which come first and are admitted again.  A request that is older
    than the last decided one of its key is decided at that one's time, as a limiter with a clock
    would.  Requests without a key are not limited.  A batch that is repeated overwrites its own
    folders, so verdicts are written once.  Keys without a request for ``keep_seconds`` are forgotten.
    """
    window = F.expr(f"interval {int(window_seconds)} seconds")

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, batch
        limited = here.where(F.col(key).isNotNull()).withColumn("_new", F.lit(1))
        if batch_id:
            held = spark.read.parquet(f"{state}/held={batch_id - 1}")
            last = held.groupBy(key).agg(F.max("_last").alias("_last"))
            limited = limited.join(last, key, "left").withColumn("_time", F.greatest(F.col(time).cast("timestamp"), "_last")).drop("_last")
            old = held.select(key, "_time", F.lit(0).alias("_new"))
            limited = limited.unionByName(old, allowMissingColumns=True)
        else:
            limited = limited.withColumn("_time", F.col(time).cast("timestamp"))
        ordered = limited.withColumn("_order", F.struct("_new", order))
        admit(ordered, key, "_time", "_order", max_requests, window_seconds).drop("_order").write.mode(
            "overwrite"
        ).parquet(f"{state}/decided={batch_id}")
        decided = spark.read.parquet(f"{state}/decided={batch_id}")

        free = here.where(F.col(key).isNull()).withColumns({"admitted": F.lit(True), "retry_after": F.lit(0)})
        verdicts = decided.where("_new = 1").select(*here.columns, "admitted", "retry_after")
        verdicts.unionByName(free).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        ends = decided.groupBy(key).agg(F.max("_time").alias("_last"))
        span = int(keep_seconds) + int(window_seconds)
        alive = ends.where(F.col("_last") >= ends.agg(F.max("_last")).scalar() - F.expr(f"interval {span} seconds"))
        recent = decided.where("admitted").join(alive, key).where(F.col("_time") >= F.col("_last") - window)
        recent.select(key, "_time", "_last").write.mode("overwrite").parquet(f"{state}/held={batch_id}")

    return (
        requests.writeStream.foreachBatch(decide)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_admitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def expire_stream(
    mapping: DataFrame,
    path: str,
    state: str,
    ttl_seconds: int = fv.SESSION_TTL_SECONDS,
) -> StreamingQuery:
    """Sessions that ran out, with their numbers of mapping entries; no entry is lost, however late.

    Input rows are mapping entries (session_id, created_at, ...).  The stream's clock is the latest creation seen.
    What is kept of an open session is its number of entries and its expiry time, never the values; that table
    holds the sessions of the last ``ttl_seconds`` and is written anew with each micro-batch.  Sessions whose
    expiry lies before the clock are reported and forgotten.  Entries that arrive after their session's expiry are
    reported with the batch that brings them, marked as late, so the counts of a session's reports add up to
    all of its entries (``read_expired``).  Entries without a creation time are reported at once; entries without a
    session are one session.  A batch that is repeated overwrites its own folders.
    """
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be positive")
    ttl = F.expr(f"interval {int(ttl_seconds)} seconds")

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = batch.select("session_id", F.col("created_at").cast("timestamp").alias("created_at"))
        sums = entries.groupBy("session_id").agg(F.count("*").alias("entity_count"), (F.max("created_at") + ttl).alias("expires_at"))
        clocks = entries.agg(F.max("created_at").alias("clock"))
        before = F.lit(None).cast("timestamp")
        if batch_id:
            sums = sums.unionByName(spark.read.schema(sums.schema).parquet(f"{state}/held={batch_id - 1}"))
            sums = sums.groupBy("session_id").agg(F.sum("entity_count").alias("entity_count"), F.max("expires_at").alias("expires_at"))
            last = spark.read.schema(clocks.schema).parquet(f"{state}/clock={batch_id - 1}")
            before = F.lit(last.first()["clock"]).cast("timestamp")
            clocks = clocks.unionByName(last).agg(F.max("clock").alias("clock"))
        clocks.write.mode("overwrite").parquet(f"{state}/clock={batch_id}")
        clock = F.lit(spark.read.schema(clocks.schema).parquet(f"{state}/clock={batch_id}").first()["clock"]).cast("timestamp")
        gone = F.coalesce(F.col("expires_at") < clock, F.lit(True))
        sums.withColumn("gone", gone).withColumn("late", F.coalesce(F.col("expires_at") < before, F.col("expires_at").isNull())).write.mode(
            "overwrite"
        ).parquet(f"{state}/decided={batch_id}")
        decided = spark.read.parquet(f"{state}/decided={batch_id}")
        decided.where("gone").drop("gone").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        decided.where("NOT gone").drop("gone", "late").write.mode("overwrite").parquet(f"{state}/held={batch_id}")

    return (
        mapping.writeStream.foreachBatch(decide)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_expired(spark: SparkSession, path: str) -> DataFrame:
    """One row per session: session_id, entity_count, expires_at, late_entries."""
    schema = "session_id string, entity_count bigint, expires_at timestamp, late boolean, batch int"
    late = F.sum(F.when(F.col("late"), F.col("entity_count")).otherwise(0))
    return spark.read.schema(schema).parquet(path).groupBy("session_id").agg(
        F.sum("entity_count").alias("entity_count"), F.max("expires_at").alias("expires_at"), late.alias("late_entries")
    )
