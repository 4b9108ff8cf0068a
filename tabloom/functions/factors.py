"""Factors: strings with an ordered list of levels, and their 1-based codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Attribute, Described, describe, description


def levels_of(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with their 1-based codes in sorted order: (level, code)."""
    from ..sources.store import with_ordinals

    distinct = df.select(F.col(column).alias("level")).where("level IS NOT NULL").distinct()
    return with_ordinals(distinct, "__o", order=["level"]).select("level", (F.col("__o") + 1).cast("int").alias("code"))


def as_factor(df: DataFrame, column: str, levels: list[str], ordered: bool = False) -> DataFrame:
    """Declare the levels of a string column; values that are no level become NULL."""
    kept = df.withColumn(column, decode(encode(F.col(column), levels), levels))
    kind = Attribute.FACTOR_ORDERED if ordered else Attribute.FACTOR_BASE
    return describe(kept, column, Described(kind, levels=tuple(levels)))


def _array(levels: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<string>")


def encode(c: Column, levels: list[str]) -> Column:
    """1-based code; NULL for NULL and for values that are no level, so always for no levels."""
    return F.nullif(F.array_position(_array(levels), c).cast("int"), F.lit(0))


def decode(code: Column, levels: list[str]) -> Column:
    """The level of a 1-based code; NULL out of range."""
    return F.get(_array(levels), code - 1)


def order_by_level(df: DataFrame, column: str) -> DataFrame:
    """Sort by the position of the levels, NULLs last."""
    levels = list(description(df.schema[column]).levels or ())
    return df.orderBy(encode(F.col(column), levels).asc_nulls_last())


def code_width(n_levels: Column) -> Column:
    """Bytes of a stored code: 1 for fewer than 128 levels, 2 for fewer than 32768, else 4."""
    return F.when(n_levels < 128, 1).when(n_levels < 32_768, 2).otherwise(4)
