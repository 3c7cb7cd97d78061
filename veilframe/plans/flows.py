"""Whole flows over a table of documents, each one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.settle import settled
from ..operators import chunk, report
from ..operators.detect import many_rules
from ..operators.outside import detect_any
from ..operators.restore import restore
from ..operators.tokens import anonymise, as_map, highlight, redact
from ..operators.validate import check_anonymised, check_restored


def anonymise_only(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """The input with ``entities``, ``anonymized_text``, ``entity_map`` and ``validation``."""
    many = many_rules(threshold, types)
    return check_anonymised(anonymise(detect_any(documents, text, threshold, types), text, many=many), many=many)


def rehydrate_only(texts: DataFrame, text: str = "anonymized_text") -> DataFrame:
    """``rehydrated_text`` and ``validation`` for texts that carry their ``entity_map``."""
    return check_restored(restore(texts, text))


def process(
    documents: DataFrame,
    text: str = "text",
    template: str = fv.DEFAULT_PROMPT,
    limit: int = fv.DEFAULT_CHUNK_CHARS,
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | None = None,
    stop_on_error: bool = True,
    responder: Callable[[list[str]], list[str]] | None = None,
) -> DataFrame:
    """Anonymise, prompt a responder, restore its answer and check both ways.

    A text whose anonymised form fails its check is not sent: its row keeps the errors, has
    the reason in ``stopped`` and no answer.
    """
    safe = anonymise_only(documents, text, threshold, types)
    sendable = F.col("validation.is_valid") | F.lit(not stop_on_error)
    held = safe.withColumn("stopped", F.when(~sendable, F.lit(fv.UNSAFE_ERROR)))
    sent = held.withColumn("_sent", F.when(F.col("stopped").isNull(), F.col("anonymized_text")))
    answered = chunk.respond(chunk.with_prompts(sent, "_sent", template, limit), responder)
    final = check_restored(
        restore(answered.withColumnRenamed("validation", "_before"), "llm_response_anonymized")
    )
    answered_row = F.col("stopped").isNull()
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in (text, "hits")]
    return final.select(
        *kept,
        report.entity_payload(F.col("entities"), include_values=True).alias("detected_entities"),
        "anonymized_text",
        F.when(answered_row, F.col("llm_response_anonymized")).alias("llm_response_anonymized"),
        F.when(answered_row, F.col("rehydrated_text")).alias("final_response"),
        as_map().alias("entity_map"),
        F.struct(
            F.col("_before").alias("anonymization"),
            F.when(answered_row, F.col("validation")).alias("rehydration"),
        ).alias("validation"),
        "stopped",
    )


def highlighted(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    return highlight(detect_any(documents, text, **options), text)


def redacted(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    return redact(anonymise(detect_any(documents, text, **options), text, many=many_rules(**options)))


def public_output(anonymised: DataFrame, *keep: str, include_values: bool = False) -> DataFrame:
    """What may leave the system: no mapping, and values only when asked for."""
    return anonymised.select(
        *keep,
        "anonymized_text",
        report.entity_payload(F.col("entities"), include_values).alias("entities"),
        F.size("entities").alias("entity_count"),
        "validation",
    )


def stateless_output(anonymised: DataFrame, *keep: str) -> DataFrame:
    """The same with the mapping, for a client that keeps it."""
    rows = settled(anonymised, mapping=as_map())
    return rows.select(
        *keep, "anonymized_text", F.size("entities").alias("entity_count"), "validation", "mapping"
    )
