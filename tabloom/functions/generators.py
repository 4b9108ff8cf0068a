"""Columns of made-up values for tests, without randomness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def int_sequence(spark: SparkSession, n: int, start: int = 0, modulus: int = 2**31 - 1) -> DataFrame:
    """(i, value): start + i, modulo *modulus*."""
    return spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + start) % modulus).cast("int").alias("value"))


def int_constant(spark: SparkSession, n: int, value: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(value).cast("int").alias("value"))


def double_sequence(spark: SparkSession, n: int, start: float, delta: float) -> DataFrame:
    """start + delta, start + 2 delta, ..."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + (F.col("id") + 1) * delta).cast("double").alias("value"))


def logical_values(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """True, false and missing values by a hash, the same for the same seed."""
    three = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(3))
    return spark.range(n).select(F.col("id").alias("i"), F.when(three < 2, three == 1).alias("value"))
