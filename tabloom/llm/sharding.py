"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_rows

#: A prime below 2**31: products of two residues stay inside a long.
PRIME = 2_147_483_647
#: One key for each Feistel round; the count is even, so both halves end in their place.
KEYS = (1_640_531_527, 1_013_904_223, 1_566_083_941, 362_437_069, 1_181_783_497, 871_483_621)
#: After so many steps a walk is given up with an error; one step leaves the
#: range with a chance of about 1 / sqrt(rows), so it never comes to that.
MOST_STEPS = 64


def halves(n: int) -> tuple[int, int]:
    """Sizes (a, b) of the two halves: a * b >= n and a * b - n < a."""
    a = max(1, isqrt(n))
    return a, max(1, -(-n // a))


def _scramble(v: Column, key: Column) -> Column:
    t = (v % PRIME + key) % PRIME
    t = (t * t) % PRIME
    t = (t * F.lit(48_271).cast("long") + key) % PRIME
    return (t * t) % PRIME


def _permute(x: Column, n: int, seed: int) -> Column:
    """One pass of the permutation of [0, a * b)."""
    a, b = halves(n)
    rounds = [F.struct(F.lit((key + seed) % PRIME).cast("long").alias("key"), F.lit(a if i % 2 == 0 else b).cast("long").alias("size")) for i, key in enumerate(KEYS)]
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("moved"), (x % F.lit(b)).cast("long").alias("other"))
    end = F.aggregate(
        F.array(*rounds),
        start,
        lambda s, r: F.struct(s["other"].alias("moved"), ((s["moved"] + _scramble(s["other"], r["key"])) % r["size"]).alias("other")),
    )
    return end["moved"] * F.lit(b).cast("long") + end["other"]


def feistel(x: Column, n: int, seed: int = 0) -> Column:
    """A permutation of [0, n), applied to *x*; values past n walk on along their cycle.

    A walk visits each of the a * b - n values past n once at most.
    """
    a, b = halves(n)
    steps = min(a * b - n, MOST_STEPS)
    first = _permute(x, n, seed)
    if steps == 0:
        return first
    last = F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), first, lambda v, _: F.when(v < n, v).otherwise(_permute(v, n, seed)))
    if a * b - n <= MOST_STEPS:
        return last
    return F.element_at(F.transform(F.array(last), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))), 1)


def shard_rows(df: DataFrame, n_shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Deal the rows of *df* into *n_shards* shards; add ``shard`` and ``slot``.

    Rows are numbered in the order of *order*, the numbers are permuted, and
    the permuted number p gives shard p mod n_shards and slot p div n_shards:
    counts differ by one at most, and slots have no gaps. An input column
    named like an output column is dropped. Ties in *order* must be equal
    rows. An empty table gives an empty result; null keys come first.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    numbered = number_rows(df.select(*[f"`{c}`" for c in kept]), order)
    n = numbered.count()
    at = feistel(F.col("__row"), max(n, 1), seed)
    dealt = numbered.withColumn("__to", at)
    return dealt.select(*[f"`{c}`" for c in kept], (F.col("__to") % n_shards).cast("int").alias("shard"), F.floor(F.col("__to") / n_shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Shards for documents, without moving their texts: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 8 (a null text has none, and
    crc32 0). Law ``rows``: shard counts differ by one at most. Rows that
    repeat an id are numbered apart; equal rows may change places.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = shard_rows(narrow, n_shards, [id_col, "text_crc32", "size"], seed)
    return dealt.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
