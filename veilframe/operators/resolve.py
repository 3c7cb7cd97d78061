"""Confidence boost and overlap resolution over the span array of one document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import fixed_values as fv
from ..functions.arrays import BLOCK, empty, let, running
from ..functions.cached import built_once, column
from ..functions.types import SPAN


def _marked_runs(spans: Column, flag: str) -> Column:
    """Add the source that the first span of each (start, end, type) run has."""

    def same(state: Column, s: Column) -> Column:
        return (
            (state.getField("start") == s.getField("start"))
            & (state.getField("end") == s.getField("end"))
            & (state.getField("type") == s.getField("type"))
        )

    state_type = "struct<start:int,end:int,type:string,source:string>"

    def step(state: Column, s: Column) -> Column:
        fresh = F.struct(*[s.getField(f).alias(f) for f in ("start", "end", "type", "source")])
        return F.when(same(state, s), state).otherwise(fresh.cast(state_type))

    def emit(state: Column, s: Column) -> Column:
        source = F.when(same(state, s), state.getField("source")).otherwise(s.getField("source"))
        return F.array(s.withField(flag, source))

    seed = F.struct(
        F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.lit("").alias("type"), F.lit("").alias("source"),
    ).cast(state_type)
    fields = SPAN[:-1] + ("" if flag == "low" else ",low:string") + f",{flag}:string>"
    return running(spans, seed, step, emit, fields)


def boost(spans: Column) -> Column:
    """Raise the confidence of spans on which more than one source agrees.

    In the order (start, end, type, source) a run holds several sources exactly when the
    sources at its two ends differ.
    """

    def ordered(s: Column) -> Column:
        keys = [s.getField(f).alias(f) for f in ("start", "end", "type", "source", "ord")]
        return F.struct(*keys, s.alias("span"))

    def raised(s: Column) -> Column:
        higher = F.least(F.lit(fv.BOOST_CEILING), s.getField("confidence") + F.lit(fv.BOOST))
        agreed = s.getField("low") != s.getField("high")
        plain = s.dropFields("low", "high")
        return F.when(agreed, plain.withField("confidence", higher)).otherwise(plain).cast(SPAN)

    def runs(values: Column) -> Column:
        by_run = F.transform(
            F.sort_array(F.transform(values, ordered)), lambda o: o.getField("span")
        )
        from_left = _marked_runs(by_run, "low")
        from_right = _marked_runs(F.reverse(from_left), "high")
        return F.transform(from_right, raised)

    def several_sources(values: Column) -> Column:
        return F.exists(values, lambda s: s.getField("source") != "rule")

    return let(spans, lambda v: F.when(several_sources(v), runs(v)).otherwise(v))


def without_overlaps(spans: Column) -> Column:
    """Walk by (start, longest, most confident, arrival) and keep what starts after the last."""

    def ordered(s: Column) -> Column:
        return F.struct(
            s.getField("start").alias("a"),
            (s.getField("start") - s.getField("end")).alias("b"),
            (-s.getField("confidence")).alias("c"),
            s.getField("ord").alias("d"),
            s.alias("span"),
        )

    by_position = F.transform(
        F.sort_array(F.transform(spans, ordered)), lambda o: o.getField("span")
    )

    def free(last: Column, s: Column) -> Column:
        return s.getField("start") >= last

    def places(few: Column) -> Column:
        """Which of a few spans stay: the list that grows holds numbers, not spans."""
        def step(acc: Column, s: Column) -> Column:
            i, last, out = (acc.getField(f) for f in ("i", "last", "out"))
            kept = F.struct((i + 1).alias("i"), s.getField("end").alias("last"), F.concat(out, F.array(i)).alias("out"))
            return F.when(free(last, s), kept).otherwise(F.struct((i + 1).alias("i"), last.alias("last"), out.alias("out")))

        seed = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("last"), empty("int").alias("out"))
        return F.aggregate(few, seed, step, lambda acc: acc.getField("out"))

    def whole(listed: Column) -> Column:
        few = F.transform(places(listed), lambda i: F.get(listed, i))
        return F.when(F.size(listed) <= BLOCK, few).otherwise(_walk(listed, free))

    return let(by_position, whole)


def _walk(listed: Column, free: Callable[[Column, Column], Column]) -> Column:
    return running(
        listed,
        F.lit(-1),
        lambda last, s: F.when(free(last, s), s.getField("end")).otherwise(last),
        lambda last, s: F.when(free(last, s), F.array(s)).otherwise(
            F.array().cast(f"array<{SPAN}>")
        ),
        SPAN,
    )


@built_once
def resolve(spans: str | Column, boosted: bool = True) -> Column:
    """Boost, then resolve; texts without spans skip both."""

    def whole(values: Column) -> Column:
        return F.when(
            F.size(values) > 0, without_overlaps(boost(values) if boosted else values)
        ).otherwise(values)

    return let(column(spans), whole)
