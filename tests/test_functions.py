"""Hashes, blobs, packing and layout against plain Python."""

import os
import struct
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.errors import BlobError
from tabloom.functions import blob, generators, hashing, layout, packing


def blocked(data: bytes, seed: int) -> int:
    size = max(4096, 1 + (len(data) - 1) // 48)
    hashes = [xxhash.xxh64_intdigest(data[i : i + size], seed) for i in range(0, len(data), size)]
    return hashes[0] if len(hashes) == 1 else xxhash.xxh64_intdigest(struct.pack(f"<{len(hashes)}Q", *hashes), seed)


@pytest.mark.parametrize("seed", [hashing.SEED, 0, 7, 2**63 + 5])
def test_hashes(spark, seed):
    rng = np.random.default_rng(3)
    data = [rng.bytes(n) for n in (1, 4, 8, 31, 32, 33, 100, 4095, 4096, 4097, 9000, 196_608, 196_609, 300_001)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)] + [(99, None)], "i int, d binary")
    got = {r.i: r for r in df.select("i", hashing.unsigned(hashing.hash_blob(F.col("d"), seed)).alias("h"), hashing.unsigned(hashing.hash_blocked(F.col("d"), seed)).alias("b")).collect()}
    for i, d in enumerate(data):
        assert int(got[i].h) == xxhash.xxh64_intdigest(d, seed)
        assert int(got[i].b) == blocked(d, seed)
    assert got[99].h is None and got[99].b is None


def test_empty_hash(spark):
    df = spark.createDataFrame([(bytearray(b""),)], "d binary")
    for f in (hashing.hash_blob, hashing.hash_blocked):
        with pytest.raises(Exception, match="Source contains no data."):
            df.select(f(F.col("d"))).collect()


@pytest.mark.parametrize("codec", ["lz4", "zstd"])
@pytest.mark.parametrize("check", [True, False])
@pytest.mark.parametrize("n", [1, 10, 16_384, 16_385, 1_000_003])
def test_blob(codec, check, n):
    data = (b"abcdefg" * (n // 7 + 1))[:n]
    packed = blob.compress_blob(data, codec, 50, check)
    assert blob.decompress_blob(packed) == data
    for damaged in (packed[:20], packed[:-1], packed + b"x", bytes([packed[0] ^ 1]) + packed[1:], packed[:9] + b"\xff" + packed[10:]):
        with pytest.raises(BlobError):
            blob.decompress_blob(damaged)
    if check:
        with pytest.raises(BlobError):
            blob.decompress_blob(packed[:-1] + bytes([packed[-1] ^ 1]))


def test_blob_columns(spark):
    df = spark.createDataFrame([(1, bytearray(os.urandom(100_000))), (2, None), (3, bytearray(b"x"))], "i int, b binary")
    back = blob.decompress_column(blob.compress_column(df, "b", "z"), "z", "again")
    assert all(r.b == r.again for r in back.collect())
    with pytest.raises(BlobError, match="Source contains no data."):
        blob.compress_blob(b"")
    with pytest.raises(BlobError):
        blob.decompress_blob(os.urandom(500))


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([2, 4, 8]))
def test_byte_shuffle(data, width):
    moved = packing.shuffle_bytes(data, width)
    assert len(moved) == len(data) and packing.unshuffle_bytes(moved, width) == data


@settings(max_examples=30, deadline=None)
@given(st.lists(st.booleans(), max_size=100))
def test_bitmap(missing):
    a = np.array(missing, dtype=bool)
    words = packing.missing_bitmap(a)
    assert packing.read_bitmap(words, len(a)).tolist() == missing
    assert packing.read_bitmap(words, len(a) + 1)[-1] == any(missing)


def test_narrow():
    a = np.array([-(2**31), -127, 0, 127], dtype=np.int32)
    assert packing.narrow(a, 1).tolist() == [-128, -127, 0, 127] and packing.widen(packing.narrow(a, 1)).tolist() == a.tolist()
    with pytest.raises(ValueError):
        packing.narrow(np.array([-128], dtype=np.int32), 1)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 100])
def test_pack_logicals(spark, n):
    values = [[True, False, None][i % 3] for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<boolean>")
    packed = df.select("v", packing.pack_logicals(F.col("v")).alias("w"))
    row = packed.select("w", packing.unpack_logicals(F.col("w"), F.size("v")).alias("u")).first()
    assert row.u == values and len(row.w) == -(-n // 32)


@pytest.mark.parametrize("compress", [0, 7, 23, 35, 50, 63, 88, 100])
def test_block_plan(spark, compress):
    rows = layout.block_plan(spark, 1_000_000, "double", compress).orderBy("block").collect()
    share = np.float32(layout.dense_share(compress))
    want = [int(np.float32(b + 1) * share) - int(np.float32(b) * share) >= 1 for b in range(len(rows))]
    assert [r.dense for r in rows] == want
    assert sum(r.n_rows for r in rows) == 1_000_000 and rows[1].first_row == 2049


def test_generators(spark):
    assert [r.value for r in generators.int_constant(spark, 3, 7).collect()] == [7] * 3
    assert [r.value for r in generators.int_sequence(spark, 5, 3, 4).orderBy("i").collect()] == [3, 0, 1, 2, 3]
    assert [r.value for r in generators.double_sequence(spark, 2, 1.0, 0.5).orderBy("i").collect()] == [1.5, 2.0]
    assert {r.value for r in generators.logical_values(spark, 50).collect()} == {True, False, None}


def test_storage_columns(spark):
    """The column functions against those for bytes and arrays; nulls, empty values and rests."""
    rows = [(0, None, None), (1, b"", []), (2, bytes(range(31)), [None]), (3, bytes(range(200)), ["a"] * 31), (4, bytes(range(64)), ["a", None] * 40)]
    df = spark.createDataFrame(rows, "id int, b binary, v array<string>")
    for width in (2, 4, 8):
        moved = df.select("id", "b", packing.shuffle_column(F.col("b"), width).alias("m")).select("*", packing.unshuffle_column(F.col("m"), width).alias("back"))
        for r in moved.collect():
            assert (r.m, r.back) == ((None, None) if r.b is None else (packing.shuffle_bytes(bytes(r.b), width), r.b))
    for r in df.select("v", packing.missing_words(F.col("v")).alias("w")).collect():
        assert r.w == (None if r.v is None else packing.missing_bitmap(np.array([x is None for x in r.v], bool)).tolist() if r.v else [0])
    ints = spark.createDataFrame([(None,), (-127,), (0,), (127,)], "i int").select("i", packing.narrow_column(F.col("i"), 1).alias("n")).select("*", packing.widen_column(F.col("n"), 1).alias("w"))
    assert [(r.n, r.w) for r in ints.collect()] == [(-128, None), (-127, -127), (0, 0), (127, 127)]
    with pytest.raises(Exception, match="do not fit"):
        spark.createDataFrame([(-128,)], "i int").select(packing.narrow_column(F.col("i"), 1)).collect()


def test_bitmaps_of_many_values(spark):
    """Long arrays take time in proportion, and values that lie in rows give the words of their array."""
    sizes = [1, 31, 32, 33, 64, 100, 9000]
    df = spark.createDataFrame([(k, i, None if i % 7 == k else "a") for k, n in enumerate(sizes) for i in range(n)], "k int, i int, v string")
    lists = df.repartition(3, "i").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("l"))
    want = {r.k: r.w for r in lists.select("k", packing.missing_words(F.transform("l", lambda x: x["v"])).alias("w")).collect()}
    assert want == {k: packing.missing_bitmap(np.array([i % 7 == k for i in range(n)])).tolist() for k, n in enumerate(sizes)}
    assert {r.k: r.words for r in packing.missing_words_by(df.repartition(3, "i"), "k", ["i"], "v").collect()} == want
    n = 200_000
    begun = time.monotonic()
    long = spark.range(1).select(packing.missing_words(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 7 != 0, i))).alias("w")).first().w
    assert long == packing.missing_bitmap(np.arange(1, n + 1) % 7 == 0).tolist()
    assert time.monotonic() - begun < 20


def test_codecs(spark):
    assert layout.codecs_of("int32", 80) == (("lz4 shuffled by 4", 0), ("zstd shuffled by 4", 60))
    assert {r.codec for r in layout.codec_plan(spark, 100_000, "logical", 0).collect()} == {"packed logicals"}
    assert {r.codec for r in layout.codec_plan(spark, 100_000, "double", 100).collect()} == {"zstd"}
    with pytest.raises(ValueError):
        layout.codecs_of("double", 101)
