"""Bit packing of arrays of logicals and small integers, as column functions and for numpy arrays.

The column functions work on arrays of one row; NULL elements are missing values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Logicals in a 64-bit word: two bits each.
PER_WORD = 32


def pack_logicals(values: Column) -> Column:
    """array<boolean> -> array<long>: bit 2i is the value, bit 2i + 1 says that it is missing."""
    n = F.size(values)
    words = F.sequence(F.lit(0), F.floor((n - 1) / PER_WORD).cast("int"))

    def word(w: Column) -> Column:
        part = F.slice(values, w * PER_WORD + 1, PER_WORD)
        bits = F.transform(part, lambda v, i: F.call_function("shiftleft", F.when(v.isNull(), 2).when(v, 1).otherwise(0).cast("long"), 2 * i))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(n == 0, F.array().cast("array<bigint>")).when(n > 0, F.transform(words, word))


def unpack_logicals(words: Column, n: Column) -> Column:
    """The *n* logicals of packed words."""

    def value(i: Column) -> Column:
        two = F.call_function("shiftrightunsigned", F.get(words, F.floor(i / PER_WORD).cast("int")), (2 * (i % PER_WORD)).cast("int")).bitwiseAND(F.lit(3))
        return F.when(two < 2, two == 1)

    return F.when(n == 0, F.array().cast("array<boolean>")).when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value))


def narrow_column(value: Column, width: int) -> Column:
    """int -> tinyint or smallint that holds NULL as its least value, so that nothing beside it says what is missing; an error for what does not fit."""
    kind = {1: "tinyint", 2: "smallint"}[width]
    least = -(1 << (8 * width - 1))
    fits = (value > least) & (value < -least)
    return F.when(value.isNull(), F.lit(least).cast(kind)).when(fits, value.cast(kind)).otherwise(F.raise_error(F.lit(f"values do not fit {width} bytes")).cast(kind))


def widen_column(stored: Column, width: int) -> Column:
    """What `narrow_column` was given."""
    return F.nullif(stored.cast("int"), F.lit(-(1 << (8 * width - 1))))


def _moved(data: Column, width: int, rows: int, columns: int) -> Column:
    """Each whole group of rows x columns bytes, transposed."""
    group = rows * columns

    def move(b: Column) -> Column:
        n = F.length(b)
        whole = n - n % group

        def byte(p: Column) -> Column:
            at = p % group
            return F.hex(F.substring(b, F.when(p < whole, p - at + (at % rows) * columns + F.floor(at / rows).cast("int")).otherwise(p) + 1, F.lit(1)))

        return F.when(n == 0, b).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")))

    # The variable of an outer lambda, so that the value is computed once.
    return F.element_at(F.transform(F.array(data), move), 1)


def shuffle_column(data: Column, width: int) -> Column:
    """binary -> binary: `shuffle_bytes` as a column function; NULL for NULL."""
    return F.when(data.isNotNull(), _moved(data, width, 8, width))


def unshuffle_column(data: Column, width: int) -> Column:
    return F.when(data.isNotNull(), _moved(data, width, width, 8))


def missing_words(values: Column) -> Column:
    """array -> array<long>: `missing_bitmap` as a column function, each word unsigned."""

    def words(bits: Column) -> Column:
        def word(w: Column) -> Column:
            shifted = F.transform(F.slice(bits, w * 32 + 1, 32), lambda b, i: F.call_function("shiftleft", b, i))
            return F.aggregate(shifted, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 32).cast("int")), word)

    flags = F.transform(values, lambda v: v.isNull().cast("long"))
    bits = F.concat(flags, F.array(F.exists(values, lambda v: v.isNull()).cast("long")))
    # The variable of an outer lambda, so that the bits are computed once and not for each word; NULL for NULL.
    return F.element_at(F.transform(F.when(values.isNotNull(), F.array(bits)), words), 1)


def missing_words_by(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, ``words``): `missing_words` of each key's values in the order of *order*, where these are too many for an array.

    Rows are numbered in a window, which spills, and each word gathers its own
    32 bits; so only a key's words ever lie in one row.
    """
    flag, at = F.col(value).isNull().cast("long"), (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    bits = rows.select(key, flag.alias("__flag"), at.alias("__at")).groupBy(key, F.floor(F.col("__at") / 32).alias("__w"))
    words = bits.agg(F.bit_or(F.call_function("shiftleft", F.col("__flag"), F.col("__at") % 32)).alias("__bits"), F.count(F.lit(1)).alias("__n"))
    lists = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__w", "__bits"))).alias("__l"), F.sum("__n").alias("__n"), F.max(F.col("__bits") != 0).cast("long").alias("__any"))
    whole, rest = F.transform("__l", lambda x: x["__bits"]), (F.col("__n") % 32).cast("int")
    last = F.call_function("shiftleft", F.col("__any"), rest)
    ended = F.concat(F.slice(whole, 1, F.size("__l") - 1), F.array(F.element_at(whole, -1).bitwiseOR(last)))
    return lists.select(key, F.when(rest == 0, F.concat(whole, F.array(last))).otherwise(ended).alias("words"))


def shuffle_bytes(data: bytes, width: int) -> bytes:
    """Groups of eight values of *width* bytes, transposed: all first bytes, then all second ones; a rest of fewer stays as it is."""
    group = 8 * width
    whole = len(data) // group * group
    a = np.frombuffer(data[:whole], np.uint8).reshape(-1, 8, width)
    return a.transpose(0, 2, 1).tobytes() + data[whole:]


def unshuffle_bytes(data: bytes, width: int) -> bytes:
    group = 8 * width
    whole = len(data) // group * group
    a = np.frombuffer(data[:whole], np.uint8).reshape(-1, width, 8)
    return a.transpose(0, 2, 1).tobytes() + data[whole:]


def narrow(values: np.ndarray, width: int) -> np.ndarray:
    """int32 -> int8 or int16; the missing value of one is that of the other: its least."""
    to = {1: np.int8, 2: np.int16}[width]
    low, high = np.iinfo(to).min, np.iinfo(to).max
    missing = values == np.iinfo(np.int32).min
    if ((values[~missing] <= low) | (values[~missing] > high)).any():
        raise ValueError(f"values do not fit {width} bytes")
    return np.where(missing, low, values).astype(to)


def widen(values: np.ndarray) -> np.ndarray:
    return np.where(values == np.iinfo(values.dtype).min, np.iinfo(np.int32).min, values.astype(np.int32)).astype(np.int32)


def missing_bitmap(missing: np.ndarray) -> np.ndarray:
    """One bit a string, 32 in a word, and a last bit that says whether any is missing."""
    bits = np.append(missing.astype(bool), missing.any())
    padded = np.zeros(-(-len(bits) // 32) * 32, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u4")


def read_bitmap(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)
