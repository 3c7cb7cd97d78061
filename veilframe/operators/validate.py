"""Checks in both directions: nothing leaked, no unknown token, nothing left or invented."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import batches, fixed_values as fv, substrings, text as tx
from ..functions.arrays import let
from ..functions.lookup import look_up
from ..functions.cached import built_once, column
from ..functions.settle import settled


# Up to so many characters times values, each value is searched for; beyond, the text gets a signature.
FEW = 5_000_000
GRAM = 4
# Characters of text whose grams are held at once.
PIECE = 1 << 16


def _grams(text: Column, size: int) -> Column:
    """All stretches of so many characters, overlapping, by position."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def _seen(text: Column, keys: Column) -> Column:
    """Which of the keys (distinct, up to GRAM characters) stand in the text, with one pass over it for each length."""

    def of_size(size: int):
        return lambda key: F.length(key) == size

    def in_piece(piece: Column) -> Column:
        found = [
            F.when(
                F.exists(keys, of_size(size)), F.array_intersect(F.filter(keys, of_size(size)), _grams(piece, size))
            ).otherwise(F.array().cast("array<string>"))
            for size in range(1, GRAM + 1)
        ]
        return F.concat(*found)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(pieces, in_piece)))


def _by_signature(text: Column, values: Column) -> Column:
    """The values that stand in the text.  A value is searched for only if its first and its last gram are
    among the text's; one that is itself no longer than a gram need not be."""

    def ends(v: Column) -> Column:
        return F.array(F.left(v, F.lit(GRAM)), F.right(v, F.lit(GRAM)))

    def checked(asked: Column) -> Column:
        seen = let(F.array_distinct(asked), lambda keys: _seen(text, keys))
        known = F.transform(seen, lambda k: F.struct(k.alias("token"), F.lit(None).cast("string").alias("value")))
        return let(look_up(asked, known, any_case=False), kept)

    def kept(found: Column) -> Column:
        def stands(v: Column, i: Column) -> Column:
            both = F.get(found, 2 * i).getField("found") & F.get(found, 2 * i + 1).getField("found")
            return (text.isNotNull() & (v == "")) | (both & ((F.length(v) <= GRAM) | F.contains(text, v)))

        return F.filter(values, stands)

    return let(F.flatten(F.transform(values, ends)), checked)


def leaked_values(anonymized: Column, entries: Column) -> Column:
    """Map values that are still in the text, case-sensitive."""

    def search(values: Column) -> Column:
        few = F.size(values).cast("bigint") * F.length(anonymized) <= FEW
        return F.when(few, F.filter(values, lambda v: F.contains(anonymized, v))).otherwise(_by_signature(anonymized, values))

    return let(F.transform(F.filter(entries, lambda e: e.getField("value").isNotNull()), lambda e: e.getField("value")), search)


def _bitmaps(values: DataFrame) -> list[bytes]:
    """Two bitmaps of fixed size: where the values' hashes and those of their heads fall."""
    places = values.mapInArrow(substrings.value_places, "kind int, place bigint")
    parts = places.groupBy("kind", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = [bytearray(1 << (substrings.BITS - 3)) for _ in range(2)]
    for part in parts.toLocalIterator():
        begin = (part["bucket"] - 1) * len(part["bits"])
        out[part["kind"]][begin : begin + len(part["bits"])] = part["bits"]
    return [bytes(bitmap) for bitmap in out]


def leaks_of_table(
    texts: DataFrame, mapping: DataFrame, *scope: str, key: str, text: str = "anonymized_text", most: int = fv.MAX_MAPPING_ENTRIES
) -> DataFrame:
    """Values of a mapping kept apart that stand in texts of their scope: scope, key, value, once each.

    One pass over the texts gives the stretches that may be values, by two bitmaps of the values' hashes, which are all
    that every task holds; an equality join with the values of the scope decides.  A scope's texts never meet all of its
    values, so ``most``, once the size of a block of them, no longer matters.
    """
    values = mapping.where(F.col("value").isNotNull()).select(*scope, "value").distinct()
    raw = values.select(F.col("value").cast("binary").alias("value")).distinct()
    lengths = sorted(r[0] for r in raw.select(F.length("value")).distinct().collect())
    shared = texts.sparkSession.sparkContext.broadcast(_bitmaps(raw))

    def stretches(batches):
        return substrings.candidates(batches, lengths, shared)

    asked = texts.select(*scope, key, F.col(text).cast("binary").alias("value"))
    met = asked.mapInArrow(stretches, asked.schema).withColumn("value", F.col("value").cast("string"))
    return met.join(values, [*scope, "value"]).select(*scope, key, "value")


def unknown_in(text: Column, entries: Column, known: bool = False) -> Column:
    """Tokens of the text that are not (or, on request, are) in the map."""

    def wanted(tokens: Column) -> Column:
        return let(
            look_up(tokens, entries),
            lambda found: F.filter(
                tokens, lambda t, i: F.get(found, i).getField("found") == F.lit(known)
            ),
        )

    return let(tx.tokens_in(text), wanted)


def _messages(values: Column, message: str, width: int | None = None) -> Column:
    shown = (lambda v: tx.truncated(v, width)) if width else (lambda v: v)
    return F.transform(values, lambda v: F.format_string(message, shown(v)))


def _result(errors: Column) -> Column:
    return let(
        errors,
        lambda e: F.struct(
            (F.size(e) == 0).alias("is_valid"),
            F.array().cast("array<string>").alias("warnings"),
            e.alias("errors"),
        ),
    )


@built_once
def anonymised_result(anonymized: str | Column, entries: str | Column) -> Column:
    anonymized, entries = column(anonymized), column(entries)
    leaks = _messages(leaked_values(anonymized, entries), fv.LEAK_ERROR, 30)
    unknown = _messages(unknown_in(anonymized, entries), fv.UNKNOWN_TOKEN_ERROR)
    return _result(F.concat(leaks, unknown))


@built_once
def restored_result(restored: str | Column, entries: str | Column) -> Column:
    """One error per token that is left over or made up, in text order."""
    restored, entries = column(restored), column(entries)

    def errors(tokens: Column) -> Column:
        return let(
            look_up(tokens, entries),
            lambda found: F.transform(
                tokens,
                lambda t, i: F.when(
                    F.get(found, i).getField("found"), F.format_string(fv.LEFT_TOKEN_ERROR, t)
                ).otherwise(F.format_string(fv.INVENTED_TOKEN_ERROR, t)),
            ),
        )

    return _result(let(tx.tokens_in(restored), errors))


def _errors_in_batches(text: str, entries: str) -> Column:
    """The errors of ``anonymised_result``, null for rows that are left."""

    @F.arrow_udf("array<string>")
    def errors_batch(texts: pa.Array, tokens: pa.Array, values: pa.Array) -> pa.Array:
        return batches.anonymised_errors(texts, tokens, values)

    return errors_batch(F.col(text).cast("binary"), F.col(f"{entries}.token"), F.col(f"{entries}.value"))


def check_anonymised(
    documents: DataFrame, text: str = "anonymized_text", entries: str = "entity_map", many: bool = False
) -> DataFrame:
    """Add ``validation``.  Maps with ``many`` entries are checked in batches, as in ``tokens.anonymise``."""
    if not many:
        return settled(documents, validation=anonymised_result(text, entries))
    done = settled(documents, _errors=_errors_in_batches(text, entries))
    left = F.col("_errors").isNull()
    rest = settled(done, _text=F.when(left, F.col(text)), _entries=F.when(left, F.col(entries)))
    checked = F.when(left, anonymised_result("_text", "_entries")).otherwise(_result(F.col("_errors")))
    return settled(rest, validation=checked).drop("_errors", "_text", "_entries")


def check_restored(
    documents: DataFrame, text: str = "rehydrated_text", entries: str = "entity_map"
) -> DataFrame:
    return settled(documents, validation=restored_result(text, entries))


def gate(documents: DataFrame, stop_on_error: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that may be sent on, and rows held back with the reason."""
    if not stop_on_error:
        return documents, documents.where(F.lit(False)).withColumn("reason", F.lit(""))
    passed = documents.where(F.col("validation.is_valid"))
    held = documents.where(~F.col("validation.is_valid"))
    return passed, held.withColumn("reason", F.lit(fv.UNSAFE_ERROR))


def token_occurrences(texts: DataFrame, *scope: str, text: str) -> DataFrame:
    """One row per token in a text: scope columns, place and token."""
    rows = texts.select(*scope, F.posexplode_outer(tx.tokens_in(F.col(text))).alias("place", "token"))
    return rows.where(F.col("token").isNotNull())


def unknown_tokens(
    texts: DataFrame, mapping: DataFrame, *scope: str, text: str = "anonymized_text"
) -> DataFrame:
    """Token occurrences without a row in the mapping table (anti join on scope and token)."""
    found = token_occurrences(texts, *scope, text=text)
    known = mapping.select(*scope, F.upper("token").alias("_key"))
    return (
        found.withColumn("_key", F.upper("token"))
        .join(known, [*scope, "_key"], "left_anti")
        .drop("_key")
    )


def leftover_tokens(
    texts: DataFrame, mapping: DataFrame, *scope: str, text: str = "rehydrated_text"
) -> DataFrame:
    """Token occurrences in final texts, each with its error: left over or invented."""
    found = token_occurrences(texts, *scope, text=text)
    known = (
        mapping.select(*scope, F.upper("token").alias("_key")).distinct().withColumn("_in", F.lit(1))
    )
    joined = found.withColumn("_key", F.upper("token")).join(known, [*scope, "_key"], "left")
    error = F.when(
        F.col("_in").isNotNull(), F.format_string(fv.LEFT_TOKEN_ERROR, F.col("token"))
    ).otherwise(F.format_string(fv.INVENTED_TOKEN_ERROR, F.col("token")))
    return joined.select(*scope, "place", "token", error.alias("error"))
