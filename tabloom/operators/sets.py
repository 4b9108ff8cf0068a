"""Set operations on tables with the same column names. NULLs are equal to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def setequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same distinct rows. One pass over both, by counting sides."""
    sides = a.select("*", F.lit(1).alias("__side")).unionByName(b.select(*a.columns, F.lit(2).alias("__side")))
    seen = sides.groupBy(*a.columns).agg(F.bit_or("__side").alias("__seen"))
    return seen.agg(F.coalesce(F.bool_and(F.col("__seen") == 3), F.lit(True)).alias("setequal"))
