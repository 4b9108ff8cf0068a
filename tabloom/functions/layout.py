"""Block arithmetic: which codec a block gets at a setting of the dial, and which blocks a row range touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block by stored type.
BLOCK_ROWS = {"character": 2047, "factor": 4096, "int32": 4096, "double": 2048, "logical": 4096, "int64": 2048, "byte": 16384, "byte block": 2048}

# The two codecs that a setting mixes, for settings up to 50 and above, by stored type. After a codec
# its level: a * setting + b as (a, b). Factors are stored in 1, 2 or 4 bytes by their number of levels.
CODECS = {
    "int32": ((("uncompressed", (0, 0)), ("lz4 shuffled by 4", (0, 0))), (("lz4 shuffled by 4", (0, 0)), ("zstd shuffled by 4", (2, -100)))),
    "int64": ((("uncompressed", (0, 0)), ("lz4 shuffled by 8", (2, 0))), (("lz4 shuffled by 8", (0, 100)), ("zstd shuffled by 8", (1, -50)))),
    "double": ((("uncompressed", (0, 0)), ("lz4", (0, 50))), (("lz4", (1, 0)), ("zstd", (1, -50)))),
    "logical": ((("packed logicals", (0, 0)), ("lz4 of packed logicals", (0, 100))), (("lz4 of packed logicals", (0, 100)), ("zstd of packed logicals", (2, -100)))),
    "byte": ((("uncompressed", (0, 0)), ("lz4", (0, 0))), (("lz4", (0, 0)), ("zstd", (0, 0)))),
    "character": ((("uncompressed", (0, 0)), ("lz4", (0, 20))), (("lz4", (0, 20)), ("zstd", (0, 20)))),
    "factor in 1 byte": ((("narrowed", (0, 0)), ("lz4 of narrowed", (1, 0))), (("lz4 of narrowed", (1, 0)), ("zstd of narrowed", (1, -50)))),
    "factor in 2 bytes": ((("lz4 of narrowed, shuffled by 2", (0, 0)), ("zstd of narrowed, shuffled by 2", (0, 0))), (("zstd of narrowed, shuffled by 2", (0, 0)), ("zstd of narrowed, shuffled by 2", (1, -50)))),
    "factor in 4 bytes": ((("uncompressed", (0, 0)), ("lz4 shuffled by 4", (0, 0))), (("lz4 shuffled by 4", (0, 0)), ("zstd shuffled by 4", (2, -100)))),
}


def codecs_of(kind: str, compress: int) -> tuple[tuple[str, int], tuple[str, int]]:
    """(codec, level) of the blocks that `dense_block` leaves out, and of those that it picks."""
    if not 0 <= compress <= 100:
        raise ValueError("compress must be between 0 and 100")
    plain, dense = CODECS[kind][compress > 50]
    return tuple((name, a * compress + b) for name, (a, b) in (plain, dense))


def codec_plan(spark: SparkSession, n_rows: int, kind: str, compress: int) -> DataFrame:
    """`block_plan` with the codec and level of each block in place of dense."""
    (plain, low), (dense, high) = codecs_of(kind, compress)
    picked = F.col("dense")
    blocks = block_plan(spark, n_rows, kind.split()[0], compress)
    return blocks.select("block", "first_row", "n_rows", F.when(picked, dense).otherwise(plain).alias("codec"), F.when(picked, high).otherwise(low).alias("level"))


def dense_share(compress: int) -> float:
    """The share of blocks with the denser codec of the two that a setting mixes."""
    return 2 * compress / 100 if compress <= 50 else 2 * (compress - 50) / 100


def dense_block(block: Column, compress: int) -> Column:
    """Whether a 0-based block gets the denser codec. Single precision, so that the spread over the blocks is the same everywhere."""
    share = F.lit(dense_share(compress)).cast("float")

    def part(b: Column) -> Column:
        return F.floor((b.cast("float") * share).cast("float")).cast("long")

    return (part(block + 1) - part(block)) >= 1


def block_plan(spark: SparkSession, n_rows: int, kind: str, compress: int) -> DataFrame:
    """One row a block: block, first_row (1-based), n_rows, dense."""
    size = BLOCK_ROWS[kind]
    blocks = spark.range(-(-n_rows // size)).withColumnRenamed("id", "block")
    first = F.col("block") * size
    return blocks.select("block", (first + 1).alias("first_row"), F.least(F.lit(size).cast("long"), F.lit(n_rows) - first).alias("n_rows"), dense_block(F.col("block"), compress).alias("dense"))


def block_range(from_row: Column, to_row: Column, size: int) -> tuple[Column, Column, Column]:
    """For 1-based rows: first and last block, and the offset of the first row in its block."""
    return F.floor((from_row - 1) / size).cast("long"), F.floor((to_row - 1) / size).cast("long"), ((from_row - 1) % size).cast("long")
