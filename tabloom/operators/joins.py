"""Joins on equal keys. The physical join is left to Catalyst and to adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TableError
from ..sources.store import with_ordinals


def _join(a: DataFrame, b: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise TableError("a join needs keys")
    return a.join(b, keys, how)


def inner_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return _join(a, b, on, "inner")


def left_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return _join(a, b, on, "left")


def right_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return _join(a, b, on, "right")


def full_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """All rows of both; the keys of unmatched rows come from the side that has them."""
    return _join(a, b, on, "full")


def semi_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Rows of a with a partner in b."""
    return _join(a, b, on, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Rows of a without a partner in b; NULL keys have none and stay."""
    return _join(a, b, on, "left_anti")


def bind_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of both side by side, row by row; the numbers of rows must be equal."""
    n, m = a.count(), b.count()
    if n != m:
        raise TableError(f"tables have {n} and {m} rows")
    if {c.lower() for c in a.columns} & {c.lower() for c in b.columns}:
        raise TableError("column names clash")
    left, right = with_ordinals(a, "__l"), with_ordinals(b, "__r")
    return left.join(right, F.col("__l") == F.col("__r")).drop("__l", "__r")
