"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary; the engine's own is Unicode-aware.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it
    inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def among(column: Column, words: Iterable[str]) -> Column:
    return column.isin(*words)


def trim(column: Column) -> Column:
    """Strip every character up to the blank, at both ends."""
    return F.regexp_replace(column, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(column: Column) -> Column:
    return column.isNull() | (trim(column) == "")


def rounded(column: Column, places: int = 6) -> Column:
    return F.round(column.cast("double"), places)
