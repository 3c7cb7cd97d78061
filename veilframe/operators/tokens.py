"""Placeholders: numbering, anonymised text, entity map, highlighting and redaction.

All of it works on the entity array of one row.  Numbers run from right to left: the last
value of a type in the text gets 001.  Values with the same key share the token that the
rightmost of them got, whatever their types; the leftmost spelling is what is kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import batches, text as tx
from ..functions.arrays import let, pieces, running
from ..functions.cached import built_once, column
from ..functions.settle import settled
from ..functions.types import ENTRY

_OCCURRENCE = "struct<group:int,first:boolean,last_start:int,place:int,type:string,value:string>"
_NUMBERED = "struct<group:int,token:string>"
# Up to so many entities of a text, keys are numbered without folding.
FEW = 256


def _field(struct: Column, name: str) -> Column:
    return struct.getField(name)


def _occurrences(entities: Column) -> Column:
    """The entities by (key, rightmost first), with a number per key."""
    by_key = F.sort_array(
        F.transform(
            entities,
            lambda e, i: F.struct(
                tx.value_key(_field(e, "value")).alias("key"),
                (-_field(e, "start")).alias("back"),
                i.alias("place"),
                _field(e, "type").alias("type"),
                _field(e, "value").alias("value"),
            ),
        )
    )
    seed = F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).alias("group"))

    def fresh(state: Column, o: Column) -> Column:
        return ~_field(state, "key").eqNullSafe(_field(o, "key"))

    def group(state: Column, o: Column) -> Column:
        return _field(state, "group") + fresh(state, o).cast("int")

    return running(
        by_key,
        seed,
        lambda state, o: F.struct(_field(o, "key").alias("key"), group(state, o).alias("group")),
        lambda state, o: F.array(
            F.struct(
                group(state, o).alias("group"),
                fresh(state, o).alias("first"),
                (-_field(o, "back")).alias("last_start"),
                _field(o, "place").alias("place"),
                _field(o, "type").alias("type"),
                _field(o, "value").alias("value"),
            ).cast(_OCCURRENCE)
        ),
        _OCCURRENCE,
    )


def _tokens_by_group(firsts: Column) -> Column:
    """One token per key, in key order: count within the type, from right to left."""
    by_type = F.sort_array(
        F.transform(
            firsts,
            lambda o: F.struct(
                _field(o, "type").alias("type"),
                (-_field(o, "last_start")).alias("back"),
                _field(o, "group").alias("group"),
            ),
        )
    )
    seed = F.struct(F.lit("").alias("type"), F.lit(0).alias("number"))

    def number(state: Column, o: Column) -> Column:
        same = _field(state, "type") == _field(o, "type")
        return F.when(same, _field(state, "number") + 1).otherwise(F.lit(1))

    numbered = running(
        by_type,
        seed,
        lambda state, o: F.struct(
            _field(o, "type").alias("type"), number(state, o).alias("number")
        ),
        lambda state, o: F.array(
            F.struct(
                _field(o, "group").alias("group"),
                tx.token(_field(o, "type"), number(state, o)).alias("token"),
            ).cast(_NUMBERED)
        ),
        _NUMBERED,
    )
    return F.transform(F.sort_array(numbered), lambda n: _field(n, "token"))


def _numbered_by_search(entities: Column) -> Column:
    """The numbering of a few entities: sorted lists are cut where keys and types change, nothing is folded."""

    def changes(items: Column, name: str) -> Column:
        """Where runs of a field begin."""
        def fresh(i: Column) -> Column:
            return (i == 0) | ~_field(F.get(items, i), name).eqNullSafe(_field(F.get(items, i - 1), name))

        every = F.sequence(F.lit(0), F.size(items) - 1)
        return F.when(F.size(items) > 0, F.filter(every, fresh)).otherwise(F.array().cast("array<int>"))

    def stop(begins: Column, items: Column, g: Column) -> Column:
        return F.coalesce(F.get(begins, g + 1), F.size(items))

    def tokens_of(by_type: Column) -> Column:
        """Tokens by (type, order of use), put back into the order of keys."""
        def numbered(begins: Column) -> Column:
            return F.flatten(F.transform(begins, lambda b, j: F.transform(
                F.slice(by_type, b + 1, stop(begins, by_type, j) - b),
                lambda o, i: F.struct(_field(o, "group").alias("group"), tx.token(_field(o, "type"), i + 1).alias("token")),
            )))

        return F.transform(F.sort_array(let(changes(by_type, "type"), numbered)), lambda n: _field(n, "token"))

    def from_keys(by_key: Column) -> Column:
        def from_groups(begins: Column) -> Column:
            # A key's rightmost use comes first and gives the type, its leftmost comes last and gives the value.
            by_type = F.transform(begins, lambda b, g: F.struct(
                _field(F.get(by_key, b), "type").alias("type"), _field(F.get(by_key, b), "back").alias("back"), g.alias("group"),
            ))

            def put(tokens: Column) -> Column:
                used = F.transform(begins, lambda b, g: F.struct(
                    _field(F.get(by_key, b), "back").alias("back"), F.get(tokens, g).alias("token"),
                    _field(F.get(by_key, stop(begins, by_key, g) - 1), "value").alias("value"),
                ))
                placed = F.flatten(F.transform(begins, lambda b, g: F.transform(
                    F.slice(by_key, b + 1, stop(begins, by_key, g) - b),
                    lambda o: F.struct((-_field(o, "back")).alias("place"), F.get(tokens, g).alias("token")),
                )))
                return F.struct(
                    F.transform(F.sort_array(placed), lambda p: _field(p, "token")).alias("tokens"),
                    F.transform(F.sort_array(used), lambda u: F.struct(_field(u, "token").alias("token"), _field(u, "value").alias("value")).cast(ENTRY)).alias("entries"),
                )

            return let(let(F.sort_array(by_type), tokens_of), put)

        return let(changes(by_key, "key"), from_groups)

    def keyed(e: Column, i: Column) -> Column:
        key = tx.value_key(_field(e, "value"))
        return F.struct(key.alias("key"), (-i).alias("back"), _field(e, "type").alias("type"), _field(e, "value").alias("value"))

    return let(F.sort_array(F.transform(entities, keyed)), from_keys)


@built_once
def numbering(entities: str | Column) -> Column:
    """A struct of ``tokens`` (one per entity, by position) and ``entity_map`` (entries in
    the order of first use, from the right)."""
    listed = column(entities)
    starts = F.transform(listed, lambda e: _field(e, "start"))
    plain = ~F.exists(listed, lambda e: _field(e, "value").isNull() | _field(e, "type").isNull()) & (F.sort_array(F.array_distinct(starts)) == starts)
    return F.when((F.size(listed) <= FEW) & plain, _numbered_by_search(listed)).otherwise(_numbered_by_groups(listed))


def _numbered_by_groups(entities: Column) -> Column:
    def from_groups(occurrences: Column, tokens: Column) -> Column:
        placed = F.sort_array(
            F.transform(
                occurrences,
                lambda o: F.struct(
                    _field(o, "place").alias("place"),
                    F.get(tokens, _field(o, "group")).alias("token"),
                ),
            )
        )
        # Within a key the leftmost occurrence comes last.
        leftmost = F.transform(
            F.filter(
                occurrences,
                lambda o, i: F.coalesce(
                    _field(F.get(occurrences, i + 1), "first"), F.lit(True)
                ),
            ),
            lambda o: _field(o, "value"),
        )
        used = F.sort_array(
            F.transform(
                F.filter(occurrences, lambda o: _field(o, "first")),
                lambda o: F.struct(
                    (-_field(o, "last_start")).alias("back"), _field(o, "group").alias("group")
                ),
            )
        )
        entries = let(
            leftmost,
            lambda values: F.transform(
                used,
                lambda u: F.struct(
                    F.get(tokens, _field(u, "group")).alias("token"),
                    F.get(values, _field(u, "group")).alias("value"),
                ).cast(ENTRY),
            ),
        )
        return F.struct(
            F.transform(placed, lambda p: _field(p, "token")).alias("tokens"),
            entries.alias("entries"),
        )

    return let(
        _occurrences(entities),
        lambda occurrences: let(
            _tokens_by_group(F.filter(occurrences, lambda o: _field(o, "first"))),
            lambda tokens: from_groups(occurrences, tokens),
        ),
    )


@built_once
def splice(text: str, entities: str, replacements: str) -> Column:
    """The text with each entity replaced by the entry at its place."""

    def spliced(new: Column) -> Column:
        cuts = F.concat(
            F.array(F.lit(0)),
            F.flatten(F.transform(entities, lambda e: F.array(_field(e, "start"), _field(e, "end")))),
            F.array(F.length(text)),
        )
        parts = F.transform(
            pieces(F.col(text), cuts),
            lambda p, i: F.when(i % 2 == 1, F.get(new, F.floor(i / 2).cast("int"))).otherwise(p),
        )
        return F.array_join(parts, "")

    return F.when(F.size(entities) > 0, let(F.col(replacements), spliced)).otherwise(F.col(text))


def _anonymised_in_batches(text: str, entities: str) -> Column:
    """A struct of ``anonymized_text`` and ``entity_map``, both null for rows that are left."""

    @F.arrow_udf(f"struct<anonymized_text:string,entity_map:array<{ENTRY}>>")
    def anonymised_batch(texts: pa.Array, starts: pa.Array, ends: pa.Array, types: pa.Array, values: pa.Array) -> pa.Array:
        return batches.anonymised(texts, starts, ends, types, values)

    return anonymised_batch(F.col(text).cast("binary"), *[F.col(f"{entities}.{name}") for name in ("start", "end", "type", "value")])


def anonymise(documents: DataFrame, text: str = "text", entities: str = "entities", many: bool = False) -> DataFrame:
    """Add ``anonymized_text`` and ``entity_map`` (array of token and value).

    Where texts have ``many`` entities, batches of them are done outside the JVM, and only the rows that these leave by
    Column expressions; the results are the same.
    """
    if not many:
        numbered = settled(documents, _numbered=numbering(entities))
        return settled(
            numbered,
            anonymized_text=splice(text, entities, "_numbered.tokens"),
            entity_map=F.col("_numbered.entries"),
        ).drop("_numbered")
    done = settled(documents, _done=_anonymised_in_batches(text, entities))
    left = F.col("_done.anonymized_text").isNull()
    rest = settled(done, _entities=F.when(left, F.col(entities)), _text=F.when(left, F.col(text)))
    rest = settled(rest, _numbered=numbering("_entities"))
    return settled(
        rest,
        anonymized_text=F.when(left, splice("_text", "_entities", "_numbered.tokens")).otherwise(F.col("_done.anonymized_text")),
        entity_map=F.when(left, F.col("_numbered.entries")).otherwise(F.col("_done.entity_map")),
    ).drop("_done", "_entities", "_text", "_numbered")


def highlight(documents: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Add ``highlighted_text``: each entity as {value|TYPE:confidence}."""

    def shown(e: Column) -> Column:
        return F.concat(
            F.lit("{"), _field(e, "value"), F.lit("|"), _field(e, "type"), F.lit(":"),
            F.format_number(_field(e, "confidence"), 2), F.lit("}"),
        )

    listed = settled(documents, _shown=F.transform(entities, shown))
    return settled(listed, highlighted_text=splice(text, entities, "_shown")).drop("_shown")


def redact(documents: DataFrame, anonymized: str = "anonymized_text") -> DataFrame:
    """Add ``redacted_text``: every placeholder, also one the source held, as [REDACTED]."""
    return documents.withColumn("redacted_text", tx.redact(F.col(anonymized)))


def as_map(entries: str = "entity_map") -> Column:
    return F.map_from_entries(F.col(entries))


def mapping_table(documents: DataFrame, *scope: str, entries: str = "entity_map") -> DataFrame:
    """One row per token, to be kept apart from the anonymised texts."""
    rows = documents.select(*scope, F.inline_outer(entries))
    return rows.where(F.col("token").isNotNull())
