"""Sessions: mappings that may be used for restoring until they expire."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text as tx
from ..functions.hidden import with_keys
from .restore import restore_from_table


def _after(time: Column, seconds: int) -> Column:
    return time + F.expr(f"interval {int(seconds)} seconds")


def create_sessions(
    mapping: DataFrame, scope: str, now: Column, ttl_seconds: int = fv.SESSION_TTL_SECONDS
) -> DataFrame:
    """Give every scope a session: id, creation and expiry time on each mapping row.

    The id is a keyed hash of the scope, with a new random key per call: it cannot be guessed,
    and a task that runs again after a lost executor makes the same ids.
    """
    if ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be positive")
    keyed = with_keys(
        mapping.withColumn("_batch", F.lit("now")), {"now": secrets.token_hex(32)}, "_batch"
    )
    return keyed.select(
        *mapping.columns,
        F.sha2(F.concat_ws("|", "_key", F.col(scope).cast("string"), "_key"), 256).alias("session_id"),
        now.alias("created_at"),
        _after(now, ttl_seconds).alias("expires_at"),
    )


def live(sessions: DataFrame, now: Column) -> DataFrame:
    """A session lives up to and including its expiry time."""
    return sessions.where(F.col("expires_at") >= now)


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") < now)


def status(sessions: DataFrame, now: Column) -> DataFrame:
    """Metadata of live sessions, never the mapping."""
    return (
        live(sessions, now)
        .groupBy("session_id", "created_at", "expires_at")
        .agg(F.count("token").alias("entity_count"))
        .withColumn("expires_in", tx.seconds_left(F.col("expires_at"), now))
    )


def active_count(sessions: DataFrame, now: Column) -> DataFrame:
    """How many sessions live.  Distinct ids first, so the count itself is a combined sum."""
    return live(sessions, now).select("session_id").distinct().agg(F.count("*").alias("active"))


def evict(sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the number of sessions removed."""
    gone = expired(sessions, now).select("session_id").distinct()
    return live(sessions, now), gone.agg(F.count("*").alias("removed"))


def delete(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id"), "session_id", "left_anti")


def restore_with_sessions(
    texts: DataFrame, sessions: DataFrame, now: Column, key: str, text: str = "response"
) -> tuple[DataFrame, DataFrame]:
    """Restored texts of live sessions, and the texts whose session is unknown or expired."""
    alive = live(sessions, now)
    ids = alive.select("session_id").distinct()
    known = texts.join(ids, "session_id", "left_semi")
    missed = texts.join(ids, "session_id", "left_anti")
    return restore_from_table(known, alive, "session_id", key, text), missed
