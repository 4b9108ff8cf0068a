"""Projection, filter, order, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import check_range, resolve, with_ordinals


def select(df: DataFrame, *columns: str) -> DataFrame:
    """Named columns in the order given; exact names, repeats allowed."""
    return df.select(*[F.col(f"`{c}`") for c in resolve(df.columns, list(columns))])


def mutate(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, or replace those of the same name; the rest stay."""
    return df.withColumns(columns)


def rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    resolve(df.columns, list(new_to_old.values()))
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def set_names(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def pull(df: DataFrame, column: str) -> DataFrame:
    """One column, lazily."""
    return select(df, column)


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows for which all conditions are true; unknown drops."""
    for c in conditions:
        df = df.where(c)
    return df


def slice_rows(df: DataFrame, from_row: int, to_row: int = -1) -> DataFrame:
    """Rows by their 1-based ordinals in the order they have."""
    numbered = with_ordinals(df, "__ordinal")
    first, length = check_range(df.count(), from_row, to_row)
    return numbered.where((F.col("__ordinal") >= first) & (F.col("__ordinal") < first + length)).drop("__ordinal")


def arrange(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Sort; a name sorts ascending, ``-name`` descending, both with NULLs last."""

    def order(k):
        if isinstance(k, Column):
            return k
        return F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last()

    return df.orderBy(*[order(k) for k in keys])


def top_n(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The first n rows of the order; a heap in each partition, no full sort."""
    return arrange(df, *keys).limit(n)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, or distinct values of some columns."""
    return select(df, *columns).distinct() if columns else df.distinct()


def _draw(seed: int, key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of *key*: the same rows whatever the partitioning."""
    return df.orderBy(_draw(seed, key), *key).limit(n)


def sample_frac(df: DataFrame, fraction: float, key: list[str], seed: int = 0) -> DataFrame:
    """Rows whose hash falls below the fraction: no shuffle, and the same rows whatever the partitioning."""
    bound = format(min(int(fraction * 16**8), 16**8 - 1), "08x")
    drawn = F.substring(_draw(seed, key), 1, 8)
    return df.where(drawn <= bound) if fraction >= 1 else df.where(drawn < bound)
