"""Put the original values back into texts that hold tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed_values as fv
from ..functions.arrays import let
from ..functions.lookup import look_up
from ..functions.cached import built_once, column
from ..functions.settle import settled
from ..functions.text import tokens_in
from ..functions.types import ENTRY
from .joins import join_hot_keys

_TOKEN = "(?iu)" + fv.TOKEN_PATTERN


@built_once
def restored(text: str | Column, entries: str | Column) -> Column:
    """Replace every token of the map by its value, case ignored, in one pass.

    Values are put in as they are and are not searched for tokens again.
    """
    text, entries = column(text), column(entries)

    def whole(tokens: Column) -> Column:
        def joined(found: Column, between: Column) -> Column:
            after = F.transform(
                F.slice(between, 2, F.size(tokens)),
                lambda rest, i: F.concat(
                    F.coalesce(F.get(found, i).getField("value"), F.get(tokens, i)), rest
                ),
            )
            return F.concat(F.get(between, F.lit(0)), F.array_join(after, ""))

        return let(
            look_up(tokens, entries),
            lambda found: let(F.split(text, _TOKEN, -1), lambda between: joined(found, between)),
        )

    return let(
        tokens_in(text), lambda tokens: F.when(F.size(tokens) > 0, whole(tokens)).otherwise(text)
    )


class _Keys:
    """Keys of one map, looked up by length: the work is text length times different lengths."""

    def __init__(self, entries):
        self.values, self.starts = {}, {}
        for entry in entries:
            key = entry["token"]
            self.values[key.upper()] = entry["value"]
            if key:
                self.starts.setdefault(key[0].upper(), set()).add(len(key))

    def put_back(self, text: str) -> str:
        out, copied, place = [], 0, 0
        while place < len(text):
            for size in sorted(self.starts.get(text[place].upper(), ()), reverse=True):
                value = self.values.get(text[place : place + size].upper())
                if value is not None:
                    out += [text[copied:place], value]
                    place += size
                    copied = place
                    break
            else:
                place += 1
        return "".join([*out, text[copied:]])


@F.pandas_udf(T.StringType())
def _restore_any_keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, maps in batches:
        pairs = zip(texts, maps)
        yield pd.Series([t if t is None else _Keys(m).put_back(t) for t, m in pairs], dtype=object)


def restored_any_keys(text: Column, entries: Column) -> Column:
    """As ``restored``, for maps whose keys need not look like tokens (longest key first)."""
    return _restore_any_keys(text, entries)


def restore(
    texts: DataFrame, text: str = "anonymized_text", entries: str = "entity_map"
) -> DataFrame:
    """Add ``rehydrated_text`` from the map that each row carries."""
    return settled(texts, rehydrated_text=restored(text, entries))


def entity_maps(texts: DataFrame, mapping: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """For each text, by its key, the part of its scope's mapping that the text refers to.

    Tokens meet the mapping one by one, so the size of a scope's mapping does not matter, and
    a token that very many texts hold is spread over tasks.  What is put together per text is
    as many entries as the text has different tokens.
    """
    asked = texts.select(
        F.col(key), F.col(scope),
        F.explode(F.array_distinct(F.transform(tokens_in(F.col(text)), F.upper))).alias("_token"),
    )
    values = mapping.groupBy(scope, F.upper("token").alias("_token")).agg(
        F.max_by("value", "token").alias("value")
    )
    answered = join_hot_keys(asked, values, scope, "_token").where(F.col("value").isNotNull())
    entry = F.struct(F.col("_token").alias("token"), "value")
    return answered.groupBy(key).agg(F.collect_list(entry).alias("entity_map"))


def restore_from_table(
    texts: DataFrame, mapping: DataFrame, scope: str, key: str, text: str = "response"
) -> DataFrame:
    """Restore each text (with a unique ``key``) from the mapping of its scope.

    ``entity_map`` holds the entries that were found; texts without any stay as they are.
    """
    joined = texts.join(entity_maps(texts, mapping, scope, key, text), key, "left")
    nothing = F.array().cast(f"array<{ENTRY}>")
    return restore(
        joined.withColumn("entity_map", F.coalesce("entity_map", nothing)), text, "entity_map"
    )
