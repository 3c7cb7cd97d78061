"""Array helpers that keep row-local work inside the JVM and close to linear.

Spark's ``aggregate`` copies its accumulator on every append, so a plain fold that collects
results costs the square of the array length.  ``running`` folds block by block instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def blocks(items: Column, size: int = BLOCK) -> Column:
    """Cut an array (a column or a lambda variable, not an expression) into blocks."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.slice(items, s, size))


def running(
    items: Column,
    seed: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    emit_type: str,
) -> Column:
    """One pass from left to right that carries a state.

    ``step(state, item)`` gives the next state, ``emit(state, item)`` an array of results for
    the item, seen with the state before it.
    """

    def one(acc: Column, item: Column) -> Column:
        state = acc.getField("state")
        return F.struct(
            step(state, item).alias("state"),
            F.concat(acc.getField("out"), emit(state, item)).alias("out"),
        )

    def one_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(
            block,
            F.struct(acc.getField("state").alias("state"), empty(emit_type).alias("out")),
            one,
        )
        return let(
            inner,
            lambda r: F.struct(
                r.getField("state").alias("state"),
                F.concat(acc.getField("out"), F.array(r.getField("out"))).alias("out"),
            ),
        )

    def whole(values: Column) -> Column:
        start = F.struct(seed.alias("state"), empty(f"array<{emit_type}>").alias("out"))
        return F.flatten(F.aggregate(blocks(values), start, one_block).getField("out"))

    return let(items, whole)


def pieces(text: Column, cuts: Column) -> Column:
    """The substrings of ``text`` between neighbouring cut points.

    ``cuts`` are ascending code point offsets that begin with 0 and end with the length.
    ``substring`` walks from the first character, so lists are first cut into coarse parts and
    then each part is cut on its own; as many cuts in a part as there are parts walk the least.
    """

    def cut(whole: Column, offset: Column, points: Column) -> Column:
        return F.transform(
            F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
            lambda end, i: F.substring(
                whole, F.get(points, i) - offset + 1, end - F.get(points, i)
            ),
        )

    def coarse(points: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(points))).cast("int")
        starts = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)), size)

        def part(s: Column) -> Column:
            return let(
                F.slice(points, s, size + 1),
                lambda sub: let(
                    F.substring(
                        text, F.get(sub, F.lit(0)) + 1, F.element_at(sub, -1) - F.get(sub, F.lit(0))
                    ),
                    lambda chunk: cut(chunk, F.get(sub, F.lit(0)), sub),
                ),
            )

        return F.flatten(F.transform(starts, part))

    return let(cuts, coarse)
