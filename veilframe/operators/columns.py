"""Which columns of a table hold personal data, judged by their names."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, text as tx
from ..functions.arrays import let


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "\\'") + "'"


def _keywords() -> Column:
    """The keyword list as one constant array, in order."""
    rows = [
        f"named_struct('keyword', {_quoted(word)}, 'type', '{type_}')"
        for type_, words in fv.HEADER_KEYWORDS
        for word in words
    ]
    return F.expr(f"array({', '.join(rows)})")


def header_type(header: Column) -> Column:
    """The type of the first keyword that the normalised header contains, else null."""

    def first(name: Column) -> Column:
        hits = F.filter(_keywords(), lambda k: F.contains(name, k.getField("keyword")))
        return F.get(hits, F.lit(0)).getField("type")

    return let(tx.normalised_header(header), first)


def classify_headers(headers: DataFrame, column: str = "column") -> DataFrame:
    return headers.withColumn("type", header_type(F.col(column)))


def profile_columns(table: DataFrame, name: str) -> DataFrame:
    """One row per column of a table: its type by name and how many values it holds."""
    return profile_tables({name: table})


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """The column profiles of several tables."""
    return classify_headers(functools.reduce(DataFrame.unionByName, map(_filled, *zip(*tables.items()))))


def _filled(name: str, table: DataFrame) -> DataFrame:
    """How many values each column holds, from one pass that is combined before the shuffle."""
    counts = table.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in table.columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled"))
            for c in table.columns
        ]
    )
    return counts.select(F.lit(name).alias("table"), F.inline(rows))


def sensitive_columns(columns: Column) -> Column:
    """Map from column name to type, for an array of names; plain columns are left out."""
    typed = F.transform(
        columns, lambda c: F.struct(c.alias("column"), header_type(c).alias("type"))
    )
    return F.map_from_entries(F.filter(typed, lambda t: t.getField("type").isNotNull()))
