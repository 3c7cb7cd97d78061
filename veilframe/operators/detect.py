"""Rule detection: one text column in, one array of spans out, without a shuffle.

A pattern is tried only on texts that pass cheap tests which every match must satisfy, so most patterns
never scan most texts.

Patterns that begin with a label do not scan at all: one pass over the lower-case text marks every place where a
label of any of them begins, and a pattern is tried only at those of its own letters, on a window that
every match fits into.  The other patterns mark their matches in a copy of the text; cutting the copy at the
marks gives the values and, by adding up lengths, their offsets.  Texts with runs of characters so long that a
match might not fit its window are scanned by all patterns.

Where many rules are in force, a scan for each of them would read a text dozens of times.  Then a batch of texts is swept
once for all (``functions/sweep.py``), and what is described above is done for the texts that the sweep leaves, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import checks, fixed_values as fv, regex, sweep
from ..functions.arrays import let, running
from ..functions.cached import built_once
from ..functions.settle import settled
from ..functions.types import SPAN, parse_types
from .resolve import resolve

# A noncharacter before and after each find, and what replaces those that are in the text already.  One character
# for both is cut at without a regular expression.
MARK, STAND_IN = "\ufdd0", "\ufdd2"

# What every match of a type or of a single pattern (by its place) holds: digits in a row (0,
# 1, 3 or 6 are told apart), a piece of lower-case text, or something found by a quick search.
# A test checks these against generated matches.
DIGITS_NEEDED = {
    "IBAN": 6, "CF": 3, "PIVA": 6, "PHONE": 1, "CAP": 3, "DATE": 3, "AMOUNT": 1, "CARD": 3,
    "CVV": 3, "CARD_EXPIRY": 1, "ADDR": 1, "PASSPORT": 6, "ID_CARD": 6, "DRIVING_LICENSE": 6,
    "PLATE": 1, "EMPLOYEE_ID": 3, "MEDICAL_ID": 3, "INSURANCE_ID": 6,
    37: 3, 38: 3, 39: 1, 41: 1, 42: 6,
}
TEXT_NEEDED = {
    0: ["@"], 4: ["+39", "0039"], 6: ["+"], 7: ["+"], 9: ["19", "20"], 10: ["19", "20"],
    11: ["19", "20"], 12: ["19", "20"], 13: ["€", "$", "£"], 14: ["€", "eur"], 22: ["/"],
    27: ["stra", "str.", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer"],
    43: ["."], 44: [":"], 45: ["::"], 47: ["://"], 48: ["www."], 49: ["@"], 53: ["med"],
    55: ["ins"],
}
SEARCH_NEEDED = {
    14: f"[0-9][{regex.SPACE}]*(?:€|[eE][uU][rR])",
    23: "[0-9]{5}",
    30: r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß'’]++[ \t]++(?:d[a-z']{0,4}[ \t]*|v[ao]n[ \t]+)?[A-ZÀ-ÖØ-Þ]",
    43: r"[0-9]\.[0-9]",
    44: ":[0-9A-Fa-f]{1,4}:",
    46: "[:-][0-9A-Fa-f]{2}[:-]",
}
# Letters that equal s and i when case is ignored but that lower() does not turn into them.
ODD_LETTERS, THEIR_TWINS = "\u017f\u0131\u0130", "sii"


def rules(threshold: float, types: list[str] | None) -> list[tuple[int, str, float, str]]:
    """The patterns in force as (order, type, confidence, pattern)."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, not {threshold}")
    return [
        (i, type_, confidence, pattern)
        for i, (type_, confidence, pattern) in enumerate(fv.PATTERNS)
        if confidence >= threshold and (not types or type_ in types)
    ]


def many_rules(threshold: float = fv.DEFAULT_THRESHOLD, types: Iterable[str] | str | None = None) -> bool:
    """Whether so many rules are in force that texts are worked on in batches."""
    return len(rules(threshold, parse_types(types))) >= MANY


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(pieces: list[str]) -> str:
    return "(" + " or ".join(f"contains(q.low, {_quoted(p)})" for p in pieces) + ")"


# A window holds any match of a label pattern in a text without runs of RUN of the characters that such patterns repeat
# without limit (a test adds up their widths).  Texts are cut into blocks that overlap by a window.
RUN, WINDOW, BLOCK = 40, 1024, 1024
LONG_RUN = f"[{regex.SPACE}.:#nNº°]{{{RUN}}}|[\\p{{L}}'’]{{{RUN}}}|[0-9.]{{{RUN}}}"
# So many finds of a pattern leave its scan as such.
FEW = 32
# So many rules in force make texts be swept in batches.
MANY = 20
FIND = "struct<ord:int,type:string,confidence:double,first:int,start:int,value:string>"
HIT = f"struct<ord:int,type:string,confidence:double,marked:string,finds:array<{FIND}>>"
HITS = f"struct<hits:array<{HIT}>,live:array<int>,starts:string,blocks:array<string>>"


def _with(name: str, value: str, body: str, type_: str) -> str:
    """SQL that works out a value once for a body that names it; the result is not copied, as one of transform would be."""
    return f"aggregate(array({value}), cast(null as {type_}), (_, {name}) -> {body})"


def _tests(ord_: int, type_: str, pattern: str) -> list[str]:
    """SQL for what a text t with lower-case text q.low and q.digits must hold for the pattern to be tried."""
    tests = []
    digits = DIGITS_NEEDED.get(type_, DIGITS_NEEDED.get(ord_))
    if digits:
        tests.append(f"q.digits >= {digits}")
    if ord_ in TEXT_NEEDED:
        tests.append(_any_of(TEXT_NEEDED[ord_]))
    if ord_ in SEARCH_NEEDED:
        tests.append(f"t rlike {_quoted(SEARCH_NEEDED[ord_])}")
    stems = regex.label_stems(pattern)
    if stems:
        tests.append(_any_of(stems))
    return tests or ["true"]


def _has_label(pattern: str) -> bool:
    return regex.label_head(pattern) is not None


def _marked(ord_: int, type_: str, confidence: float, pattern: str) -> str:
    """SQL for one pattern that scans the text; the quick tests come first.  A copy without marks equals the text.  A few
    finds leave as such, with offsets added up from the lengths of the parts; only of many the marked copy is kept."""
    find, replacement = regex.marking(pattern, MARK, MARK)
    when = f"q.wild and exists(q.live, o -> o = {ord_})" if _has_label(pattern) else " and ".join(_tests(ord_, type_, pattern))
    rule = f"'ord', {ord_}, 'type', '{type_}', 'confidence', {confidence}D"
    start = "aggregate(slice(l, 1, i), 0, (a, x) -> a + x)"
    each = f"transform(sequence(1, size(l) - 1, 2), i -> named_struct({rule}, 'first', 0, 'start', {start}, 'value', p[i]))"
    finds = _with("l", "transform(slice(p, 1, size(p) - 1), x -> length(x))", each, f"array<{FIND}>")
    kept = (
        f"if(size(p) <= {2 * FEW + 1}, named_struct({rule}, 'marked', cast(null as string), 'finds', {finds}), "
        f"named_struct({rule}, 'marked', m, 'finds', cast(array() as array<{FIND}>)))"
    )
    found = f"if(m is null or m = t, null, {_with('p', f"split(m, '{MARK}', -1)", kept, HIT)})"
    return _with("m", f"case when {when} then regexp_replace(t, {_quoted(find)}, {_quoted(replacement)}) end", found, HIT)


def _hits(text: str, chosen: list[tuple[int, str, float, str]]) -> Column:
    """A struct of ``hits``, the finds or the marked copy of the text, one per pattern that matches, and for the patterns
    with labels: ``live``, those to be tried, ``starts``, the lower-case text with the labels' beginnings marked, and ``blocks``.

    This is one SQL text because it is long: sending it to the JVM piece by piece takes
    seconds.
    """
    name = f"`{text}`"
    clean = f"if(contains({name}, '{MARK}'), translate({name}, '{MARK}', '{STAND_IN}'), {name})"
    odd = " or ".join(f"contains(t, '{c}')" for c in ODD_LETTERS)
    low = f"lower(if({odd}, translate(t, '{ODD_LETTERS}', '{THEIR_TWINS}'), t))"
    digits = (
        "case when not t rlike '[0-9]' then 0 when not t rlike '[0-9]{3}' then 1 "
        "when not t rlike '[0-9]{6}' then 3 else 6 end"
    )
    labelled = [rule for rule in chosen if _has_label(rule[3])]
    tried = ", ".join(f"case when {' and '.join(_tests(i, type_, pattern))} then {i} end" for i, type_, _, pattern in labelled)
    live = f"filter(array({tried}), i -> i is not null)" if labelled else "cast(array() as array<int>)"
    rows = ", ".join(_marked(*rule) for rule in chosen)
    starts = f"regexp_replace(q.low, {_quoted(regex.label_starts(tuple(r[3] for r in labelled)))}, '{MARK}$1$2{MARK}')" if labelled else "cast(null as string)"
    blocks = f"regexp_extract_all(t, '(?s)(?=(.{{1,{BLOCK + WINDOW}}})).{{1,{BLOCK}}}', 1)"
    labels = "size(q.live) > 0 and not q.wild"
    both = "'low', q.low, 'digits', q.digits, 'live'"
    known = "struct<low:string,digits:int,live:array<int>,wild:boolean>"
    wild = f"named_struct({both}, q.live, 'wild', size(q.live) > 0 and t rlike {_quoted(LONG_RUN)})"
    hits = (
        f"named_struct('hits', filter(array({rows}), h -> h is not null), 'live', q.live, "
        f"'starts', case when {labels} then {starts} end, 'blocks', case when {labels} then {blocks} end)"
    )
    with_wild = _with("q", _with("q", f"named_struct('low', {low}, 'digits', {digits})", f"named_struct({both}, {live})", known.replace(",wild:boolean", "")), wild, known)
    return F.expr(_with("t", clean, _with("q", with_wild, hits, HITS), HITS))


@built_once
def _label_places(starts: str) -> Column:
    """Where labels begin: (at, key), key being the next letters."""
    place = "struct<at:int,key:string>"

    def placed(parts: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(F.length(F.get(parts, i)).alias("gap"), F.get(parts, i + 1).alias("key")),
        )
        return running(
            pairs, F.lit(0), lambda at, p: at + p.getField("gap"),
            lambda at, p: F.array(F.struct((at + p.getField("gap")).alias("at"), p.getField("key").alias("key")).cast(place)), place,
        )

    found = F.when(F.contains(F.col(starts), F.lit(MARK)), let(F.split(F.col(starts), MARK, -1), placed))
    return F.coalesce(found, F.array().cast(f"array<{place}>"))


def _listed(values: list[str]) -> str:
    return ", ".join(map(_quoted, values))


def _found_at_labels(chosen: list[tuple[int, str, float, str]], places: str, live: str, blocks: str) -> Column:
    """The matches of the patterns with labels, in rule order and from left to right; one that begins before the end of the
    one before it in its pattern is none.  A place's window is cut once, for all patterns that its letters lead to."""
    labelled = [rule for rule in chosen if _has_label(rule[3])]
    if not labelled:
        return F.array().cast(f"array<{FIND}>")
    tries = []
    for ord_, type_, confidence, pattern in labelled:
        begins = " or ".join(f"left(x.key, {width}) in ({_listed(heads)})" for width, heads in regex.beginnings(pattern).items())
        find = _quoted(regex.anchored(pattern))
        # A value is never empty, so an empty one means that nothing was found.
        match = (
            f"case when v <> '' then named_struct('ord', {ord_}, 'type', '{type_}', 'confidence', {confidence}D, 'first', x.at, "
            f"'start', x.at + length(regexp_extract(w, {find}, 1)), 'value', v) end"
        )
        at_place = _with("v", f"regexp_extract(w, {find}, 2)", match, FIND)
        tries.append(f"case when ({begins}) and exists({live}, o -> o = {ord_}) then {at_place} end")
    window = f"substring({blocks}[x.at div {BLOCK}], x.at % {BLOCK} + 1, {WINDOW})"
    at_window = _with("w", window, f"filter(array({', '.join(tries)}), m -> m is not null)", f"array<{FIND}>")
    found = f"flatten(transform({places}, x -> {at_window}))"
    stop = "{m}.start + length({m}.value)"
    meets = f"exists(sequence(1, size(s) - 1), i -> s[i].first < {stop.format(m='s[i - 1]')})"
    free = (
        f"aggregate(s, cast(named_struct('last', -1, 'out', array()) as struct<last:int,out:array<{FIND}>>), (acc, m) -> "
        f"if(m.first < acc.last, acc, named_struct('last', {stop.format(m='m')}, 'out', concat(acc.out, array(m))))).out"
    )
    by_rule = "transform(array_sort(array_distinct(transform(f, m -> m.ord))), o -> filter(f, m -> m.ord = o))"
    return F.expr(_with("f", found, f"flatten(transform({by_rule}, s -> if(size(s) > 1 and {meets}, {free}, s)))", f"array<{FIND}>"))


def _finds_of(hit: Column) -> Column:
    """Cut a text with many marks; the odd parts are the values."""

    def cut(parts: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(
                F.length(F.get(parts, i)).alias("gap"),
                F.get(parts, i + 1).alias("value"),
                F.length(F.get(parts, i + 1)).alias("size"),
            ),
        )
        return running(
            pairs,
            F.lit(0),
            lambda at, p: at + p.getField("gap") + p.getField("size"),
            lambda at, p: F.array(
                F.struct(
                    *[hit.getField(f).alias(f) for f in ("ord", "type", "confidence")],
                    (at + p.getField("gap")).alias("first"),
                    (at + p.getField("gap")).alias("start"),
                    p.getField("value").alias("value"),
                ).cast(FIND)
            ),
            FIND,
        )

    many = let(F.split(hit.getField("marked"), MARK, -1), cut)
    return F.when(hit.getField("marked").isNotNull(), many).otherwise(hit.getField("finds"))


@built_once
def _spans_in(hits: str, found_at_labels: str, text: str) -> Column:
    """The spans of all scans and of all matches at labels that pass the checksum of their type, in rule order."""
    source = F.col(text)
    nothing = F.array().cast(f"array<{SPAN}>")

    def as_span(m: Column) -> Column:
        fields = [m.getField("start").alias("start"), (m.getField("start") + F.length(m.getField("value"))).alias("end")]
        fields += [m.getField(f).alias(f) for f in ("value", "type", "confidence")] + [F.lit("rule").alias("source"), m.getField("ord").alias("ord")]
        return F.struct(*fields).cast(SPAN)

    # Finds of a rule differ in where they begin, so the order of their fields is that of rules and places.
    finds = F.sort_array(F.concat(F.flatten(F.transform(hits, _finds_of)), F.col(found_at_labels)))
    both = F.transform(finds, as_span)

    def with_true_value(s: Column) -> Column:
        start = s.getField("start")
        return s.withField("value", F.substring(source, start + 1, s.getField("end") - start))

    def checked(spans: Column) -> Column:
        passed = F.filter(spans, lambda s: checks.passes_check(s.getField("type"), s.getField("value")))
        # Where the text held a mark of its own, the copies hold its stand-in.
        return F.when(source.contains(MARK), F.transform(passed, with_true_value)).otherwise(passed)

    some = (F.size(hits) > 0) | (F.size(found_at_labels) > 0)
    return F.when(source.isNotNull() & some, let(both, checked)).otherwise(nothing)


def _spans_by_sweep(text: str, chosen: list[tuple[int, str, float, str]]) -> Column:
    """The same spans, for the texts that can be swept in batches; null for the others."""
    in_force = tuple(chosen)

    @F.arrow_udf(f"array<{SPAN}>")
    def swept(texts: pa.Array) -> pa.Array:
        return sweep.spans(texts, in_force)

    return swept(F.col(text).cast("binary"))


def _scanned(documents: DataFrame, text: str, chosen: list[tuple[int, str, float, str]]) -> DataFrame:
    """Add ``spans`` by scans and by tries at labels."""
    marked = settled(documents, _hits=_hits(text, chosen))
    if not any(_has_label(rule[3]) for rule in chosen):
        bare = settled(marked, _found=F.array().cast(f"array<{FIND}>"))
        return settled(bare, spans=_spans_in("_hits.hits", "_found", text)).drop("_hits", "_found")
    placed = settled(marked, _places=_label_places("_hits.starts"))
    found = settled(placed, _found=_found_at_labels(chosen, "_places", "_hits.live", "_hits.blocks"))
    return settled(found, spans=_spans_in("_hits.hits", "_found", text)).drop("_hits", "_places", "_found")


def with_rule_spans(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | str | None = None,
) -> DataFrame:
    """Add ``spans``: all matches of the rules in force, in rule order, overlaps included."""
    chosen = rules(threshold, parse_types(types))
    if not chosen:
        return documents.withColumn("spans", F.array().cast(f"array<{SPAN}>"))
    if len(chosen) < MANY:
        return _scanned(documents, text, chosen)
    swept = settled(documents, _swept=_spans_by_sweep(text, chosen))
    rest = _scanned(settled(swept, _left=F.when(F.col("_swept").isNull(), F.col(text))), "_left", chosen)
    return settled(rest, spans=F.coalesce("_swept", "spans")).drop("_swept", "_left")


def detect(
    documents: DataFrame,
    text: str = "text",
    threshold: float = fv.DEFAULT_THRESHOLD,
    types: Iterable[str] | str | None = None,
    outside: Column | None = None,
) -> DataFrame:
    """Add ``entities``: the resolved spans of each document, by position.

    ``outside`` is an array of spans from other recognisers (see ``operators.outside``).
    """
    found = with_rule_spans(documents, text, threshold, types)
    if outside is not None:
        found = settled(found, spans=F.concat("spans", outside))
    return settled(found, entities=resolve("spans", outside is not None)).drop("spans")


def explode_spans(documents: DataFrame, *keep: str, spans: str = "entities") -> DataFrame:
    """One row per span.

    The outer form is deliberate: for the inner form the optimizer adds a size filter, pushes
    it under the projection and so runs the detection twice.
    """
    rows = documents.select(*keep, F.inline_outer(spans))
    return rows.where(F.col("start").isNotNull())
