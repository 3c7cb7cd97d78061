"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions the optimizer cannot copy.

    A filter on a plain computed column is pushed below it, with the expression put in place
    of the column.  For a detection over the whole text that means doing all the work again,
    once per use.  The output of a generator cannot be taken apart like that, so the columns
    leave an outer ``inline`` over one struct; it adds no row and no shuffle.
    """
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [f"`{c}`" for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline_outer(F.array(struct)))
