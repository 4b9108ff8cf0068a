"""Compression of binary values in hashed blocks, with integrity checks on the way back.

A compressed value is a header and its blocks. Header, little-endian: 4 bytes
XXH32 of the rest of the header, 4 version, 1 codec (1 LZ4, 2 ZSTD), 1 whether
the blocks' hashes are to be checked, 8 size, 8 block size, 8 hash of the
hashes, then for each block its end in the value (8) and its hash (8).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NO_DATA, BlobError
from ..session import prepare
from .hashing import BLOCKS, SEED

VERSION = 1
CODECS = {"lz4": 1, "zstd": 2}
LEAST_BLOCK = 16_384
LARGEST_BLOCK = int(0.8 * (2**31 - 1))
_HEAD = struct.Struct("<IIBBqqQ")


def _pack(codec: str, level: int, data: bytes) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=max(1, level * 22 // 100)).compress(data)
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def _unpack(codec: int, data: bytes, size: int) -> bytes:
    try:
        if codec == CODECS["zstd"]:
            import zstandard

            return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        return pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True)
    except Exception as e:
        raise BlobError("Compressed stream is damaged.") from e


def compress_blob(data: bytes, codec: str = "lz4", level: int = 0, check: bool = True) -> bytes:
    if codec not in CODECS:
        raise BlobError(f"no such codec: {codec}")
    if not data:
        raise BlobError(NO_DATA)
    size = min(LARGEST_BLOCK, max(LEAST_BLOCK, 1 + (len(data) - 1) // BLOCKS))
    blocks = [_pack(codec, level, data[i : i + size]) for i in range(0, len(data), size)]
    hashes = [xxhash.xxh64_intdigest(b, SEED) for b in blocks]
    ends, at = [], _HEAD.size + 16 * len(blocks)
    for b in blocks:
        at += len(b)
        ends.append(at)
    whole = xxhash.xxh64_intdigest(struct.pack(f"<{len(hashes)}Q", *hashes), SEED)
    body = _HEAD.pack(0, VERSION, CODECS[codec], int(check), len(data), size, whole)[4:] + b"".join(struct.pack("<qQ", e, h) for e, h in zip(ends, hashes, strict=True))
    return struct.pack("<I", xxhash.xxh32_intdigest(body, SEED)) + body + b"".join(blocks)


def decompress_blob(data: bytes, check: bool = True) -> bytes:
    """The value again. Checked in this order: sizes, header, version, end, blocks, stream."""
    if len(data) < _HEAD.size + 16:
        raise BlobError("Compressed value is too short.")
    mark, version, codec, checked, size, block, whole = _HEAD.unpack_from(data)
    n = -(-size // block) if block > 0 and size > 0 else 0
    head = _HEAD.size + 16 * n
    if n < 1 or len(data) <= head:
        raise BlobError("Compressed value has no blocks.")
    if xxhash.xxh32_intdigest(data[4:head], SEED) != mark:
        raise BlobError("Header is damaged.")
    if version > VERSION:
        raise BlobError("Compressed value is of a later version.")
    table = [struct.unpack_from("<qQ", data, _HEAD.size + 16 * i) for i in range(n)]
    if table[-1][0] != len(data):
        raise BlobError("Compressed value is cut off.")
    out, begin = [], head
    for i, (end, mark) in enumerate(table):
        part = data[begin:end]
        if check and checked and xxhash.xxh64_intdigest(part, SEED) != mark:
            raise BlobError("A block is damaged.")
        out.append(_unpack(codec, part, min(block, size - i * block)))
        begin = end
    return b"".join(out)


def _mapped(df: DataFrame, column: str, to: str, function) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = [None if v is None else function(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def compress_column(df: DataFrame, column: str, to: str, codec: str = "lz4", level: int = 0, check: bool = True) -> DataFrame:
    """Add *to*, each binary value of *column* compressed; NULL stays NULL."""
    return _mapped(df.withColumn(column, F.col(column).cast("binary")), column, to, lambda v: compress_blob(bytes(v), codec, level, check))


def decompress_column(df: DataFrame, column: str, to: str, check: bool = True) -> DataFrame:
    """Add *to*, the values again; a damaged one is an error."""
    return _mapped(df, column, to, lambda v: decompress_blob(bytes(v), check))
