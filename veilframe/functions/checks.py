"""Checksums of card, bank and tax numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .arrays import let
from .text import SPACE_CHARS


def _characters(text: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.substring(text, i, F.lit(1)),
    )


def luhn(value: Column) -> Column:
    """Card numbers: Luhn over the digits, at least 13 of them."""
    return let(
        F.regexp_replace(value, "[^0-9]", ""),
        lambda d: (F.length(d) >= 13) & F.call_function("luhn_check", d),
    )


def iban(value: Column) -> Column:
    """ISO 13616: country and check digits to the end, letters to 10..35, modulo 97 is 1.

    The remainder is carried from character to character, so no wide number is needed.
    """

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code < 65
        number = F.when(digit, code - 48).otherwise(code - 55)
        return (rest * F.when(digit, 10).otherwise(100) + number) % 97

    def check(clean: Column) -> Column:
        turned = F.concat(F.substring(clean, F.lit(5), F.length(clean)), F.left(clean, F.lit(4)))
        return clean.rlike("^[A-Z0-9]{5,}\\z") & (
            F.aggregate(_characters(turned), F.lit(0), add) == 1
        )

    return let(F.upper(F.translate(value, SPACE_CHARS, "")), check)


def piva(value: Column) -> Column:
    """Italian VAT number: eleven digits whose Luhn sum ends in zero."""
    return let(
        F.regexp_replace(value, "[^0-9]", ""),
        lambda d: (F.length(d) == 11) & F.call_function("luhn_check", d),
    )


def fiscal_code(value: Column) -> Column:
    """Italian fiscal code: weights by position, modulo 26 gives the last letter."""
    odd = F.array(*[F.lit(w) for w in fv.FISCAL_ODD_DIGITS + fv.FISCAL_ODD_LETTERS])

    def check(code: Column) -> Column:
        def weight(c: Column, i: Column) -> Column:
            # Digits take places 0-9 and letters 10-35 of the odd table; other characters weigh 0.
            place = F.when(c.between("0", "9"), F.ascii(c) - 48).when(
                c.between("A", "Z"), F.ascii(c) - 55
            )
            even = F.when(place < 10, place).otherwise(place - 10)
            return F.coalesce(F.when(i % 2 == 0, F.get(odd, place)).otherwise(even), F.lit(0))

        total = F.aggregate(
            F.transform(F.slice(_characters(code), 1, 15), weight), F.lit(0), lambda a, w: a + w
        )
        return (F.length(code) == 16) & (
            F.substring(code, F.lit(16), F.lit(1)) == F.char(total % 26 + 65)
        )

    return let(F.upper(value), check)


CHECKS = {"CARD": luhn, "IBAN": iban, "CF": fiscal_code, "PIVA": piva}


def passes_check(type_: Column, value: Column) -> Column:
    """True unless the type has a checksum and the value fails it."""
    result = None
    for name, check in CHECKS.items():
        cond = type_ == name
        result = F.when(cond, check(value)) if result is None else result.when(cond, check(value))
    return result.otherwise(F.lit(True))
