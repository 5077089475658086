"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def long_id(rows: DataFrame, name: str) -> Column:
    """The column of ids as long integers; an error where they are no whole numbers, rather than nulls or a cast that fails in a task."""
    kind = rows.schema[name].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids in {name} must be whole numbers, not {kind}")
    return F.col(name).cast("long")
