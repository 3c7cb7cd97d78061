"""Look up many tokens in one row's entity map.

A look-up in Spark walks the list of keys, which is the fastest while tokens times keys are few.  Many tokens against
a large map would cost their product; there two sorted lists are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let, running

FOUND = "struct<place:int,found:boolean,value:string>"
# Up to so many tokens times entries the keys are walked.
FEW = 50_000


def look_up(tokens: Column, entries: Column, any_case: bool = True) -> Column:
    """For each token, whether it is in the map (case ignored by default) and its value; later entries win."""
    few = F.size(tokens).cast("bigint") * F.size(entries) <= FEW
    return F.when(few, _walked(tokens, entries, any_case)).otherwise(_merged(tokens, entries, any_case))


def _walked(tokens: Column, entries: Column, any_case: bool) -> Column:
    def key(k: Column) -> Column:
        return F.upper(k) if any_case else k

    def answers(known: Column) -> Column:
        # From the last entry, so that the first place found is that of the latest.
        def answer(place: Column, p: Column) -> Column:
            value = F.get(known, F.size(known) - p).getField("value")
            return F.struct(place.alias("place"), (p > 0).alias("found"), F.when(p > 0, value).alias("value")).cast(FOUND)

        def places(keys: Column) -> Column:
            at = F.transform(tokens, lambda t: F.coalesce(F.array_position(keys, key(t)), F.lit(0)).cast("int"))
            return F.transform(at, lambda p, i: answer(i, p))

        return let(F.reverse(F.transform(known, lambda e: key(e.getField("token")))), places)

    return let(entries, answers)


def _merged(tokens: Column, entries: Column, any_case: bool) -> Column:
    def keyed(key: Column, kind: int, place: Column, value: Column) -> Column:
        return F.struct(
            (F.upper(key) if any_case else key).alias("key"),
            F.lit(kind).alias("kind"),
            place.alias("place"),
            value.alias("value"),
        )

    known = F.transform(
        entries, lambda e, i: keyed(e.getField("token"), 0, i, e.getField("value"))
    )
    asked = F.transform(tokens, lambda t, i: keyed(t, 1, i, F.lit(None).cast("string")))
    seed = F.struct(
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")
    )

    def step(state: Column, x: Column) -> Column:
        entry = F.struct(x.getField("key").alias("key"), x.getField("value").alias("value"))
        return F.when(x.getField("kind") == 0, entry).otherwise(state)

    def emit(state: Column, x: Column) -> Column:
        found = F.coalesce(state.getField("key") == x.getField("key"), F.lit(False))
        answer = F.struct(
            x.getField("place").alias("place"),
            found.alias("found"),
            F.when(found, state.getField("value")).alias("value"),
        ).cast(FOUND)
        return F.when(x.getField("kind") == 1, F.array(answer)).otherwise(
            F.array().cast(f"array<{FOUND}>")
        )

    answers = running(F.sort_array(F.concat(known, asked)), seed, step, emit, FOUND)
    return F.when(F.size(tokens) > 0, F.sort_array(answers)).otherwise(
        F.array().cast(f"array<{FOUND}>")
    )
