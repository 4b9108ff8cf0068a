"""64-bit content hashes without Python: XXH64 with a chosen seed, whole or in blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NO_DATA

# The seed of content hashes, and the least and the number of blocks of a blocked hash.
SEED = 912824571
LEAST_BLOCK = 4096
BLOCKS = 48
LARGEST_BLOCK = 2**31 - 1

_M = (1 << 64) - 1
# The primes of XXH64.
_P1, _P2, _P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_P4, _P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _undo_shift(x: int, by: int) -> int:
    out = x
    for _ in range(64 // by + 1):
        out = x ^ (out >> by)
    return out


def seed_literal(seed: int) -> int:
    """The long whose own hash is *seed*.

    Spark hashes several columns in a chain: the hash of one is the seed of
    the next, and the first seed is 42. The hash of a long can be inverted, so
    a literal put first makes any seed.
    """
    h = _undo_shift(seed & _M, 32)
    h = _undo_shift(h * pow(_P3, -1, 1 << 64) & _M, 29)
    h = _undo_shift(h * pow(_P2, -1, 1 << 64) & _M, 33)
    # Steps of hashLong from the seed 42, backwards.
    h = (h - _P4) * pow(_P1, -1, 1 << 64) & _M
    h = (h >> 27 | h << 37) & _M
    k = h ^ ((42 + _P5 + 8) & _M)
    k = k * pow(_P1, -1, 1 << 64) & _M
    k = (k >> 31 | k << 33) & _M
    k = k * pow(_P2, -1, 1 << 64) & _M
    return k - (1 << 64) if k >> 63 else k


def hash_blob(data: Column, seed: int = SEED) -> Column:
    """XXH64 of a binary as a signed long; NULL for NULL, an error for an empty one."""
    value = F.xxhash64(F.lit(seed_literal(seed)).cast("long"), data)
    return F.when(F.length(data) == 0, F.raise_error(F.lit(NO_DATA)).cast("long")).when(data.isNotNull(), value)


def _little_endian(h: Column) -> Column:
    digits = F.lpad(F.hex(h), 16, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)])


def hash_blocked(data: Column, seed: int = SEED) -> Column:
    """The hash of the hashes of up to 48 blocks of 4096 bytes or more; of one block, its own hash."""
    n = F.length(data).cast("long")
    size = F.least(F.lit(LARGEST_BLOCK).cast("long"), F.greatest(F.lit(LEAST_BLOCK).cast("long"), 1 + F.floor((n - 1) / BLOCKS))).cast("int")
    of = F.lit(seed_literal(seed)).cast("long")

    def blocks(b: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda i: F.xxhash64(of, F.substring(data, i * b + 1, b)))

    hashes = F.element_at(F.transform(F.array(size), blocks), 1)
    joined = F.unhex(F.array_join(F.transform(hashes, _little_endian), ""))
    value = F.when(n <= size, F.xxhash64(of, data)).otherwise(F.xxhash64(of, joined))
    return F.when(F.length(data) == 0, F.raise_error(F.lit(NO_DATA)).cast("long")).when(data.isNotNull(), value)


def unsigned(h: Column) -> Column:
    """A signed hash as the unsigned decimal it stands for."""
    d = h.cast("decimal(20,0)")
    return F.when(h < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")
