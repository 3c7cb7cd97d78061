"""Findings of outside entity recognisers: labels, clean-up, filters, union with the rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text as tx
from ..functions.arrays import let
from ..functions.regex import SPACE
from ..functions.types import HIT, SPAN, parse_types
from ..functions.cached import built_once, column
from ..functions.settle import settled

ENGINES = list(fv.RECOGNISER_LABELS)
# Rule spans come first when all else ties.
FIRST_ORD = len(fv.PATTERNS)
_NAMES = ("PERSON", "ORG", "LOC")


def _words(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), "[|]")


def label_type(engine: Column, label: Column) -> Column:
    """The type behind a recogniser's label, null if the label means nothing here."""
    pairs = ", ".join(
        f"'{engine_}|{name}', '{type_}'"
        for engine_, labels in fv.RECOGNISER_LABELS.items()
        for name, type_ in labels.items()
    )
    name = F.when(engine == "gliner", F.lower(label)).otherwise(label)
    return F.element_at(F.expr(f"map({pairs})"), F.concat_ws("|", engine, name))


def _upper_word(value: Column) -> Column:
    return value.rlike(r"^[\p{L}&&[^\p{IsLowercase}\p{Lt}]]+\z") & value.rlike(r"\p{IsUppercase}")


def _noise(word: Column) -> Column:
    """A word at the edge of a name that is no part of it."""
    lower_case = word.rlike(r"\p{IsLowercase}") & ~word.rlike(r"[\p{IsUppercase}\p{Lt}]")
    bare = F.lower(F.btrim(word, F.lit(".,;:'’")))
    return lower_case | F.array_contains(_words(fv.ARTICLES + fv.FIELD_WORDS), bare)


def _core(value: Column) -> Column:
    """Offset and length of a name without noise words at its ends, null if all is noise."""
    words = F.split(value, f"[{SPACE}]+", -1)
    gaps = F.split(value, f"[^{SPACE}]+", -1)

    def measured(w: Column, g: Column, keep: Column) -> Column:
        first = F.array_position(keep, F.lit(True)).cast("int") - 1
        last = F.size(keep) - F.array_position(F.reverse(keep), F.lit(True)).cast("int")
        steps = F.transform(w, lambda x, i: F.length(x) + F.length(F.get(g, i + 1)))
        add = lambda total, x: total + x
        offset = F.aggregate(F.slice(steps, 1, first), F.lit(0), add)
        before_last = F.aggregate(F.slice(steps, first + 1, last - first), F.lit(0), add)
        return F.when(
            F.array_contains(keep, True),
            F.struct(
                offset.alias("offset"),
                (before_last + F.length(F.get(w, last))).alias("length"),
            ),
        )

    return let(
        words,
        lambda w: let(
            gaps, lambda g: let(F.transform(w, lambda x: ~_noise(x)), lambda k: measured(w, g, k))
        ),
    )


def _cleaned(text: Column, span: Column) -> Column:
    """One span after clean-up, null if it is dropped.

    Cut at the line end, trimmed, not a field label (a colon follows), not a single word in
    capitals, not a field word; names lose noise words at both ends.
    """

    def place(start: Column, length: Column) -> Column:
        value = F.substring(text, start + 1, length)
        moved = span.withField("start", start).withField("end", start + length)
        return moved.withField("value", value).cast(SPAN)

    def judge(start: Column, value: Column) -> Column:
        end = start + F.length(value)
        label = value.endswith(":") | F.substring(text, end + 1, F.length(text)).rlike("^[ \t]*:")
        dropped = (
            (value == "")
            | label
            | (~value.contains(" ") & _upper_word(value))
            | F.array_contains(_words(fv.FIELD_WORDS), F.lower(value))
        )
        name = span.getField("type").isin(*_NAMES) & value.contains(" ")
        core = let(
            _core(value),
            lambda c: F.when(
                c.isNotNull(), place(start + c.getField("offset"), c.getField("length"))
            ),
        )
        return F.when(~dropped, F.when(name, core).otherwise(place(start, F.length(value))))

    raw = F.substring(
        text, span.getField("start") + 1, span.getField("end") - span.getField("start")
    )
    return let(
        F.substring_index(raw, "\n", 1),
        lambda line: let(
            span.getField("start")
            + F.length(line) - F.length(F.ltrim(line, F.lit(tx.SPACE_CHARS))),
            lambda start: let(tx.strip(line), lambda value: judge(start, value)),
        ),
    )


@built_once
def spans_of_hits(
    text: str | Column,
    hits: str | Column,
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: tuple[str, ...] | None = None,
) -> Column:
    """Recogniser hits of one document as cleaned spans, engine by engine.

    Unlike the rules' filter, an empty list of types lets nothing through.
    """
    text, hits = column(text), column(hits)

    def span(h: Column, i: Column) -> Column:
        default = F.element_at(
            F.create_map(*[F.lit(x) for e in ENGINES for x in (e, fv.RECOGNISER_DEFAULT_SCORE[e])]),
            h.getField("engine"),
        )
        fixed = h.getField("engine") == "spacy"
        score = F.when(fixed, default).otherwise(F.coalesce(h.getField("score"), default))
        return F.struct(
            h.getField("start").alias("start"),
            h.getField("end").alias("end"),
            F.lit("").alias("value"),
            label_type(h.getField("engine"), h.getField("label")).alias("type"),
            score.alias("confidence"),
            h.getField("engine").alias("source"),
            (F.array_position(_words(ENGINES), h.getField("engine")) * 1_000_000 + i + FIRST_ORD)
            .cast("int")
            .alias("ord"),
        ).cast(SPAN)

    known = F.filter(F.transform(hits, span), lambda s: s.getField("type").isNotNull())
    cleaned = F.filter(
        F.transform(known, lambda s: _cleaned(text, s)), lambda s: s.isNotNull()
    )
    strong = F.filter(cleaned, lambda s: s.getField("confidence") >= threshold)
    if types is not None:
        strong = F.filter(strong, lambda s: s.getField("type").isin(*types) if types else F.lit(False))
    return F.coalesce(strong, F.array().cast(f"array<{SPAN}>"))


def first_hits(hits: DataFrame, key: str) -> DataFrame:
    """Presidio reports the same hit once per language: keep the first of each.

    The smallest place is a combinable aggregate, so repeats shrink before the shuffle.
    Hits of the other engines all stay.
    """
    repeated = F.col("engine") == "presidio"
    first = (
        hits.where(repeated)
        .groupBy(key, "engine", "label", "start", "end")
        .agg(F.min(F.struct("place", "score")).alias("_first"))
        .select(key, "engine", "label", "start", "end", "_first.score", "_first.place")
    )
    return hits.where(~repeated).select(first.columns).unionByName(first)


def attach_hits(documents: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``hits`` from a table (key, engine, label, start, end, score, place).

    The key is unique in documents, so a plain join on it has no hot key.  The hits of one document are as many as its text gives rise to.
    """
    listed = first_hits(hits, key).groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("place", "engine", "label", "start", "end", "score"))
        ).alias("hits")
    )
    plain = F.transform("hits", lambda h: h.dropFields("place").cast(HIT))
    return documents.join(listed.select(key, plain.alias("hits")), key, "left")


def recognise(
    documents: DataFrame, recogniser: Callable[[str], list[dict]], text: str = "text"
) -> DataFrame:
    """Add ``hits`` by a user's recogniser: text to dicts with the fields of a hit.

    It runs on the executors; models are best loaded on its first call in a worker.
    """

    @F.pandas_udf(f"array<{HIT}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [] if t is None else list(recogniser(t)))

    return settled(documents, hits=run(F.col(text)))


def detect_with_hits(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """Rules and recogniser hits together: union, boost where they agree, resolve overlaps."""
    from .detect import detect

    types = types if types is None or isinstance(types, str) else list(types)
    chosen = parse_types(types)
    # An empty list, unlike no list, lets no hit through.
    kept = () if types == [] else chosen and tuple(chosen)
    outside = spans_of_hits(text, "hits", threshold, kept)
    return detect(documents, text, threshold, chosen, outside)


def detect_any(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | None = None,
) -> DataFrame:
    """Rules, with recogniser hits where the table has a ``hits`` column."""
    from .detect import detect

    find = detect_with_hits if "hits" in documents.columns else detect
    return find(documents, text, threshold, types)
