"""Cut long texts into prompt-sized chunks that never split a placeholder, and build prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed_values as fv, text as tx
from ..functions.settle import settled

_TOKEN = re.compile(fv.CHUNK_TOKEN_PATTERN)
_SPACE = re.compile(r"\s*")
_BREAKS = ("\n\n", ". ", " ")


def _cut_point(text: str, at: int, edge: int) -> int:
    """Where the chunk that starts at ``at`` ends: before a token that lies across the edge,
    else at the last paragraph, sentence or word break, else at the edge."""
    opening = text.rfind("[", at + 1, edge)
    if opening > at:
        token = _TOKEN.match(text, opening, edge + fv.CHUNK_PROBE_CHARS)
        if token and token.end() > edge:
            return opening
    return next((p for b in _BREAKS if (p := text.rfind(b, at + 1, edge)) > at), edge)


def _chunks(text: str, limit: int) -> list[str]:
    if limit <= 0 or len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = _cut_point(text, at, at + limit)
        out.append(text[at:cut].rstrip())
        at = _SPACE.match(text, cut).end()
    return [c for c in [*out, text[at:]] if c]


def chunks(text: Column, limit: int = fv.DEFAULT_CHUNK_CHARS) -> Column:
    """The chunks of a text in order; only texts over the limit travel to Python."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else _chunks(t, limit))

    if limit <= 0:
        return F.array(text)
    return F.coalesce(cut(F.when(F.length(text) > limit, text)), F.array(text))


def chunk(
    documents: DataFrame, text: str = "anonymized_text", limit: int = fv.DEFAULT_CHUNK_CHARS
) -> DataFrame:
    return settled(documents, chunks=chunks(F.col(text), limit))


def explode_chunks(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk with its number (from 1) and the number of chunks."""
    rows = documents.select(
        *keep, F.size("chunks").alias("parts"), F.posexplode_outer("chunks").alias("part", "chunk")
    )
    return rows.where(F.col("chunk").isNotNull()).withColumn("part", F.col("part") + 1)


def prompts(text: Column, parts: Column, template: str = fv.DEFAULT_PROMPT) -> Column:
    """A single chunk gives one prompt for the whole text, several give numbered parts; a null
    text gives null."""

    def numbered(chunk_: Column, i: Column) -> Column:
        head = F.format_string(fv.PART_FORMAT, i + 1, F.size(parts))
        return F.concat(head, tx.apply_template(template, chunk_))

    whole = F.array(tx.apply_template(template, text))
    several = F.when(F.size(parts) == 1, whole).otherwise(F.transform(parts, numbered))
    return F.when(text.isNotNull(), several)


def demo_response(prompt: Column) -> Column:
    """The built-in responder: a fixed frame around the first telling lines of the prompt."""
    telling = lambda l: l.startswith("[") | l.contains("→") | (F.length(l) > 5)
    lines = F.filter(F.split(tx.strip(prompt), "\n", -1), telling)
    preview = F.array_join(F.slice(lines, 1, fv.DEMO_PREVIEW_LINES), "\n")
    return F.concat(F.lit(fv.DEMO_HEAD), preview, F.lit(fv.DEMO_TAIL))


def respond(
    documents: DataFrame, responder: Callable[[list[str]], list[str]] | None = None
) -> DataFrame:
    """Add ``llm_response_anonymized``: the answers to ``prompts``, joined in order.

    ``responder`` is called on the executors with the prompts of one document; an object that
    is costly to make belongs in it as a lazily made field, so it is made once per worker.
    """
    if responder is None:
        answers = F.transform("prompts", demo_response)
    else:

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda p: None if p is None else list(responder(list(p))))

        answers = ask(F.col("prompts"))
    return settled(documents, llm_response_anonymized=F.array_join(answers, "\n\n"))


def with_prompts(
    documents: DataFrame,
    text: str = "anonymized_text",
    template: str = fv.DEFAULT_PROMPT,
    limit: int = fv.DEFAULT_CHUNK_CHARS,
) -> DataFrame:
    """Add ``prompts``."""
    cut = chunk(documents, text, limit)
    return settled(cut, prompts=prompts(F.col(text), F.col("chunks"), template)).drop("chunks")
