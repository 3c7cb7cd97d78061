"""Long expressions are built once per session.

A nested array expression is made of hundreds of small calls to the JVM, which take seconds
in all.  An expression over column names does not depend on the table, so it can be used
again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

_BUILT: dict[tuple, Column] = {}


def column(name_or_column: str | Column) -> Column:
    return F.col(name_or_column) if isinstance(name_or_column, str) else name_or_column


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the result for arguments that are names and plain values; columns pass through."""

    @functools.wraps(build)
    def cached(*args, **options) -> Column:
        values = [*args, *options.values()]
        if any(isinstance(v, Column) or not getattr(v, "__hash__", None) for v in values):
            return build(*args, **options)
        session = SparkSession.getActiveSession().sparkContext.applicationId
        key = (session, build.__module__, build.__qualname__, args, tuple(sorted(options.items())))
        if key not in _BUILT:
            _BUILT[key] = build(*args, **options)
        return _BUILT[key]

    return cached
