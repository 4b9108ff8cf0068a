"""Grouping and aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import with_ordinals


def summarise(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row a group, NULL keys being a group; one row in all without keys."""
    aggregates = [v.alias(k) for k, v in values.items()]
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def n_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return df.agg(F.lit(1).cast("long").alias("n_groups"))
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_groups"))


def group_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and number of rows, ordered by the keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def group_indices(df: DataFrame, keys: list[str], name: str = "group_index") -> DataFrame:
    """Add the 1-based rank of each row's group in the order of the keys.

    Ranks are given to the distinct keys by a range sort and joined back, so
    that no window runs over the rows, nor over all keys in one task.
    """
    ranked = with_ordinals(df.select(*keys).distinct(), "__rank", order=keys)
    named = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("__rank") + 1).alias(name))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(named, same).drop(*[f"__k{i}" for i in range(len(keys))])


def do_per_group(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Any computation on each group as a pandas frame. A group must fit one task's memory: this is the one verb with that limit."""
    return df.groupBy(*keys).applyInPandas(function, schema)
