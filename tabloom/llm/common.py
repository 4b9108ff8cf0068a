"""What the corpus operators share: the shared folder, cut lineage, global row numbers."""

from __future__ import annotations

import ctypes
import gc
import json
import sys
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import fixed, shared_dir

#: Words are runs of characters that are none of these.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def new_dir(spark: SparkSession, kind: str) -> str:
    """A name below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    return fixed(df)


def cut_narrow(df: DataFrame) -> DataFrame:
    """The same for narrow rows that many joins follow: as many tasks as there are 100,000 rows, so that small tables take no tasks of their own each."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // 100_000)))


#: Bits of a sieve at most, as a power of two: 8 MB.
SIEVE_BITS = 26


def sieve(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the one column of *hashes* (64-bit hashes), 16 bits or more a row up to 2**SIEVE_BITS.

    Values that it does not hold are not in the column; of others one in
    sixteen passes, or more where the table is very large. So it may only thin
    out what a join decides afterwards. Its size is bounded, whatever the input's.
    """
    (name,) = hashes.columns
    size = min(SIEVE_BITS, max(16, (16 * hashes.count()).bit_length()))
    at = F.col(name).bitwiseAND(F.lit((1 << size) - 1))
    words = hashes.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def sifted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the sieve lets it pass."""
    at = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def passes(spark: SparkSession, bitmap: np.ndarray, hashed: Column) -> Column:
    """Whether the sieve lets the rows' hash pass."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(sifted(held.value, h.to_numpy(dtype=np.int64)))

    return test(hashed)


def give_back() -> None:
    """Return memory that this process has freed but keeps to the system: a worker that serves one stage after another keeps the most that any of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # not in every C library
    if trim is not None:
        trim(0)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bind(value: Column, body) -> Column:
    """``body(v)`` with *value* computed once per row.

    A reference to a computed column inside a lambda would be computed again
    for each element; the variable of an outer lambda is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def range_bounds(keys: DataFrame, n: int) -> list[tuple]:
    """Keys that divide *keys*, in the order of its columns (nulls first), into at most *n* ranges of about equal rows.

    Each is the least key of its range; the first is the least of all. At most
    *n* rows are collected. Rows of equal keys are never parted.
    """
    names = keys.columns
    dealt = keys.repartitionByRange(n, *names)
    lows = dealt.groupBy(F.spark_partition_id().alias("__p")).agg(F.min(F.struct(*names)).alias("low"))
    found = {tuple(r["low"]) for r in lows.collect()}
    return sorted(found, key=lambda k: [(x is not None, x if x is not None else 0) for x in k])


def bound_table(bounds: list[tuple], kind: str) -> Column:
    """Bounds as one constant, an array of structs of type *kind*, whose fields are a, b, .."""
    return F.from_json(F.lit(json.dumps([dict(zip("abcdefgh", r, strict=False)) for r in bounds])), f"array<{kind}>")


def range_of(key: Column, bounds: list[tuple], kind: str) -> Column:
    """The number, from 0, of the range of *bounds* that *key* lies in; -1 before all. *key* is a struct of type *kind*.

    Two steps of about the root of their number each.
    """
    if not bounds:
        return F.lit(-1)
    step = max(1, int(len(bounds) ** 0.5))

    whole, coarse = bound_table(bounds, kind), bound_table(bounds[::step], kind)

    def search(k: Column) -> Column:
        upto = F.size(F.filter(coarse, lambda b: b <= k))
        return F.when(upto == 0, F.lit(-1)).otherwise((upto - 1) * step + F.size(F.filter(F.slice(whole, (upto - 1) * step + 1, step), lambda b: b <= k)) - 1)

    return bind(key.cast(kind), search)


def number_rows(df: DataFrame, order: list[str], row: str = "__row") -> DataFrame:
    """Add *row*, the 0-based global position in the order of *order* (nulls first).

    One range shuffle; each partition numbers its own sorted rows, and a table
    of at most one row per partition holds what comes before it. The numbers
    are fixed by a checkpoint, so that a lost executor cannot change them.
    Ties must be rows that are equal in all that is used later.
    """
    n = n_parts(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fixed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("__pid", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = fixed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    # At most one row for each partition: safe to broadcast.
    return fixed.join(F.broadcast(before), "__pid").withColumn(row, F.col("__before") + F.col("__at")).drop("__pid", "__at", "__before")
