"""Small text expressions shared by the operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import fixed_values as fv

# The characters that count as white space when values and chunks are stripped.
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Characters that can change under NFC, as a superset: combining marks, jamo, signs with a
# canonical twin and the scripts whose vowels compose.  Text without them is NFC already.
MAY_CHANGE = (
    r"[\p{M}\x{340}-\x{387}\x{958}-\x{FFF}\x{1000}-\x{11FF}\x{1B00}-\x{1BFF}"
    r"\x{1F00}-\x{2001}\x{2126}-\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FB4F}"
    r"\x{11000}-\x{11FFF}\x{16000}-\x{16FFF}\x{1D000}-\x{1D1FF}\x{2F800}-\x{2FA1F}]"
)


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC.  Only text that may change travels to Python, the rest as null."""
    return F.coalesce(_nfc(F.when(text.rlike(MAY_CHANGE), text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def value_key(value: Column) -> Column:
    """Values with the same key share a token, whatever their type."""
    return F.lower(strip(value))


def token(type_: Column, number: Column) -> Column:
    return F.format_string(fv.TOKEN_FORMAT, type_, number)


def tokens_in(text: Column) -> Column:
    """Every token-shaped substring in any case, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit("(?iu)" + fv.TOKEN_PATTERN), F.lit(0))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, fv.TOKEN_PATTERN, fv.REDACTED)


def rounded(number: Column, places: int) -> Column:
    """Round to the nearest decimal of the exact binary value, ties to even."""
    return F.format_number(number, places).cast("double")


def truncated(value: Column, width: int) -> Column:
    return F.left(value, F.lit(width))


def normalised_header(header: Column) -> Column:
    return F.translate(strip(F.lower(header)), "_-", "  ")


def apply_template(template: str | Column, document: Column) -> Column:
    """Put the document in place of ``{document}``; other braces stay."""
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(template, F.lit("{document}"), document)


def safe_path(path: Column) -> Column:
    """Hide the session id in a request path before it is stored in a log table."""
    return F.regexp_replace(path, r"^(/api/session/).+$", "$1<id>")


def seconds_left(expires_at: Column, now: Column) -> Column:
    """Whole seconds until expiry, never negative."""
    micros = F.unix_micros(expires_at) - F.unix_micros(now)
    return F.greatest(F.lit(0), F.floor(micros / F.lit(1_000_000))).cast("int")


def silent(text: Column, entity_count: Column) -> Column:
    """Nothing found in a text long enough that this may point to a reading error."""
    return (entity_count == 0) & (F.length(text) > fv.SILENT_TEXT_CHARS)


def within_limits(text: Column) -> Column:
    return F.length(text).between(1, fv.MAX_TEXT_CHARS)
