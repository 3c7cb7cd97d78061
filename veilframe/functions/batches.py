"""Numbering, splicing and checking of a batch of texts with many entities each.

These are the plain versions of what ``operators/tokens.py`` and ``operators/validate.py`` say in Column expressions, with
the same results; a row for which that is not certain (absent parts, entities out of order, letters whose case the two
sides may see differently, a large map) is left to the expressions and gets a null.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import fixed_values as fv

TOKEN = re.compile(fv.TOKEN_PATTERN, re.IGNORECASE)
# Letters below have one lower and one upper case everywhere.
PLAIN = chr(0x130)
# Characters times values up to which each value is searched for.
FEW = 5_000_000


@functools.cache
def _odd(character: str) -> bool:
    """Whether the two sides may disagree on the character's other case."""
    return character >= PLAIN and (character.lower() != character or character.upper() != character or unicodedata.category(character) == "Cn")


def _lists(column: pa.ListArray) -> Iterator[list | None]:
    """The lists of a column, strings as bytes."""
    values = column.values
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    every, offsets = values.to_pylist(), column.offsets.to_pylist()
    for i, present in enumerate(column.is_valid().to_pylist()):
        yield every[offsets[i]:offsets[i + 1]] if present else None


def _listed(rows: list[list | None], made) -> pa.ListArray:
    """Lists, some of them absent, with an array made of all their items."""
    sizes = [len(row or ()) for row in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    items = [item for row in rows if row for item in row]
    return pa.ListArray.from_arrays(offsets, made(items), mask=pa.array([row is None for row in rows], pa.bool_()))


def _strings(items: list[str]) -> pa.Array:
    return pa.array(items, pa.string())


def _entries(items: list[tuple[str, str]]) -> pa.Array:
    return pa.StructArray.from_arrays([_strings([t for t, _ in items]), _strings([v for _, v in items])], names=["token", "value"])


def _anonymised(text: str, starts: list[int], ends: list[int], types: list[str], values: list[str]) -> tuple[str, list] | None:
    if any(a >= b for a, b in zip(starts, starts[1:])) or any(e > s for e, s in zip(ends, starts[1:])) or any(e < s for s, e in zip(starts, ends)):
        return None
    if starts and (starts[0] < 0 or ends[-1] > len(text)):
        return None
    given: dict[str, str] = {}
    counts: dict[str, int] = {}
    mapping: dict[str, str] = {}
    out, end = [], len(text)
    for start, stop, type_, value in zip(starts[::-1], ends[::-1], types[::-1], values[::-1]):
        if not value.isascii() and any(map(_odd, value)):
            return None
        key = value.strip().lower()
        token = given.get(key)
        if token is None:
            counts[type_] = number = counts.get(type_, 0) + 1
            given[key] = token = fv.TOKEN_FORMAT % (type_, number)
        mapping[token] = value
        out += [text[stop:end], token]
        end = start
    out.append(text[:end])
    return "".join(out[::-1]), [*mapping.items()]


def anonymised(texts: pa.Array, starts: pa.Array, ends: pa.Array, types: pa.Array, values: pa.Array) -> pa.Array:
    """For each text (binary) and its entities: anonymized_text and entity_map."""
    rows = []
    for row in zip(texts.to_pylist(), *map(_lists, (starts, ends, types, values))):
        try:
            text, starts_, ends_, types_, values_ = row
            rows.append(_anonymised(text.decode(), starts_, ends_, [t.decode() for t in types_], [v.decode() for v in values_]))
        except (AttributeError, TypeError, UnicodeDecodeError):  # something is absent or cannot be read
            rows.append(None)
    texts_ = pa.array([row and row[0] for row in rows], pa.string())
    return pa.StructArray.from_arrays([texts_, _listed([row and row[1] for row in rows], _entries)], names=["anonymized_text", "entity_map"])


def _errors(text: str, tokens: list[str], values: list[str]) -> list[str] | None:
    if len(values) * len(text) > FEW or not all(map(str.isascii, tokens)):
        return None
    known = {token.upper() for token in tokens}
    leaks = [fv.LEAK_ERROR % value[:30] for value in values if value in text]
    return leaks + [fv.UNKNOWN_TOKEN_ERROR % token for token in TOKEN.findall(text) if token.upper() not in known]


def anonymised_errors(texts: pa.Array, tokens: pa.Array, values: pa.Array) -> pa.Array:
    """For each anonymised text (binary) and its map: what leaked, and unknown tokens."""
    rows = []
    for text, tokens_, values_ in zip(texts.to_pylist(), _lists(tokens), _lists(values)):
        try:
            rows.append(_errors(text.decode(), [t.decode() for t in tokens_], [v.decode() for v in values_]))
        except (AttributeError, TypeError, UnicodeDecodeError):
            rows.append(None)
    return _listed(rows, _strings)
