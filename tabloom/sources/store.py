"""Tables stored as Parquet, with ordinals, keys and column descriptions.

A stored table is a Parquet dataset with one more column, ``__row``: the part
that wrote a row, times 2**SHIFT, plus the row's place in it. It is made while
rows are written, so they are computed once, whatever the plan; and its values
rise in the order of the rows. How many rows each part has is read back from
what was written and kept in the folder ``_ordinals`` beside the files. So a
range of ordinals is one interval of ``__row``, and the minima and maxima in
the footers let it skip what lies outside. The field's metadata hold the format
version, the column names in order and the keys, so that a table is
self-contained, zero columns included. Parquet datasets without ``__row`` can
be read too; their ordinals are the order of the files and of the rows in them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_RANGE, NOT_POSITIVE, OUT_OF_RANGE, ColumnNotFound, RowRangeError, TableError
from ..runtime import fixed
from ..types import KEY, Described, description

ROW = "__row"
VERSION = 1
SHIFT = 33
_EXTENTS = "_ordinals"


@dataclass(frozen=True)
class TableMeta:
    """What is known of a table without reading its data."""

    names: list[str]
    types: list[str]
    descriptions: list[Described]
    n_rows: int
    keys: list[str]
    version: int


def codec_options(compress: int) -> dict[str, str]:
    """Writer options for the dial: 0 none, 1-50 fast, 51-100 dense, with rising levels."""
    if not 0 <= compress <= 100:
        raise ValueError("compress must be between 0 and 100")
    if compress == 0:
        return {"compression": "uncompressed"}
    if compress <= 50:
        return {"compression": "lz4_raw"}
    # Beyond level 6 files shrink by a few hundredths, at many times the cost.
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(max(1, 6 * (compress - 50) // 50))}


def _ordered(df: DataFrame, order: list[str] | None) -> DataFrame:
    if not order:
        return df
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_last() for c in order]
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def with_ordinals(df: DataFrame, row: str = ROW, order: list[str] | None = None) -> DataFrame:
    """Add the 0-based ordinal of each row, in the order of *order* or else the one the rows have.

    The rows and their places are fixed by a checkpoint first: another run of
    the plan may deal them otherwise. Then what comes before each partition is
    a table of a row a partition, so nothing is gathered.
    """
    at = fixed(_ordered(df, order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", SHIFT)
    sizes = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    # A row for each partition: safe to broadcast.
    numbered = at.join(F.broadcast(before), part == F.col("__part"), "left")
    known = F.when(F.col("__before").isNull(), F.raise_error(F.lit("a partition has no ordinals")).cast("long")).otherwise(F.col("__before"))
    ordinal = known + F.col("__at").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return numbered.select(*[f"`{c}`" for c in df.columns], ordinal.alias(row))


def write_table(df: DataFrame, path: str, compress: int = 0, keys: list[str] | None = None, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Store *df*; an existing table is replaced.

    *keys* declares sort keys; they are recorded and not enforced. *order*
    sorts the rows first; else they keep the order that they have when written.
    """
    names = list(df.columns)
    if ROW in names:
        raise TableError(f"column name {ROW} is reserved")
    if len(set(names)) != len(names):
        raise TableError("column names repeat")
    for k in keys or []:
        if k not in names:
            raise ColumnNotFound(k)
    head = {"version": VERSION, "names": names, "keys": list(keys or [])}
    head = {KEY: head | {"hash": _head_hash(head)}}
    if _clashing(names):  # names that differ by case only are stored by position
        plain = [f"c{i}" for i in range(len(names))]
        fields = {p: f.metadata for p, f in zip(plain, df.schema.fields, strict=True)}
        df = df.toDF(*plain)
        df = df.select(*[F.col(p).alias(p, metadata=m) for p, m in fields.items()])
        order = [plain[names.index(k)] for k in order] if order else None
    write_parts(_ordered(df, order), path, compress, head, 0, mode)


def write_parts(df: DataFrame, path: str, compress: int, head: dict, first_part: int, mode: str) -> None:
    """Write rows as the parts from *first_part* on, and record how many each has."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id() + F.lit(first_part << SHIFT)
    df.withColumn(ROW, at).withMetadata(ROW, head).write.mode(mode).options(**codec_options(compress)).parquet(path)
    extents = _written(spark.read.parquet(path).where(F.col(ROW) >= first_part << SHIFT))
    found = spark.createDataFrame(extents, "part long, n long") if extents else spark.createDataFrame([], "part long, n long")
    found.coalesce(1).write.mode(mode).parquet(f"{path}/{_EXTENTS}")


def _written(raw: DataFrame) -> list[tuple[int, int]]:
    """(part, rows) of what is stored, in order: one row a task that wrote. Places that are not 0 .. rows - 1 are an error."""
    at = F.col(ROW).bitwiseAND(F.lit((1 << SHIFT) - 1))
    found = raw.groupBy(F.shiftright(ROW, SHIFT).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect()
    if any(r["low"] != 0 or r["high"] != r["n"] - 1 for r in found):
        raise TableError("The ordinals of the table are damaged.")
    return sorted((r["part"], r["n"]) for r in found)


def extents(spark: SparkSession, path: str, raw: DataFrame) -> list[tuple[int, int]]:
    """(part, rows) in the order of the rows: as recorded, or counted anew where the record does not agree with the footers."""
    n = raw.count()
    try:
        kept = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path.rstrip('/')}/{_EXTENTS}").collect())
    except (PySparkException, Py4JJavaError):
        kept = []
    return kept if sum(k for _, k in kept) == n else _written(raw)


def _interval(parts: list[tuple[int, int]], first: int, length: int) -> tuple[int, int]:
    """The interval of ``__row`` of the rows first .. first + length."""
    low = high = before = 0
    for part, n in parts:
        if before <= first < before + n:
            low = (part << SHIFT) + first - before
        if before < first + length <= before + n:
            high = (part << SHIFT) + first + length - before
        before += n
    return (low, high) if length else (0, 0)


def _head_hash(head: dict) -> str:
    """Hash of a table's head, which a reader checks before it trusts names and keys."""
    return xxhash.xxh64_hexdigest(json.dumps([head["version"], head["names"], head["keys"]]))


def _clashing(names: list[str]) -> bool:
    return len({n.lower() for n in names}) != len(names)


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    """The raw rows and the head; None for a Parquet dataset that is not one of ours."""
    try:
        raw = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        raise TableError(f"Unable to open table '{path}'.") from e
    head = raw.schema[ROW].metadata.get(KEY) if ROW in raw.columns else None
    if head and head["version"] > VERSION:
        raise TableError(f"Table '{path}' has format version {head['version']}; this library reads up to {VERSION}.")
    if head and head.get("hash") != _head_hash(head):
        raise TableError(f"The head of table '{path}' is damaged.")
    return raw, head


def _logical(raw: DataFrame, head: dict | None) -> tuple[list[str], dict[str, str]]:
    """Column names in order, and where each is stored."""
    if head is None:
        return list(raw.columns), {c: c for c in raw.columns}
    names = list(head["names"])
    return names, {n: f"c{i}" if _clashing(names) else n for i, n in enumerate(names)}


def table_meta(spark: SparkSession, path: str) -> TableMeta:
    """Names, types, descriptions, keys and number of rows. The rows are counted from the footers."""
    raw, head = _open(spark, path)
    names, stored = _logical(raw, head)
    fields = [raw.schema[stored[n]] for n in names]
    return TableMeta(names, [f.dataType.simpleString() for f in fields], [description(f) for f in fields], raw.count(), list(head["keys"]) if head else [], head["version"] if head else 0)


def meta_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row a column: position, name, type, n_rows."""
    m = table_meta(spark, path)
    return spark.createDataFrame([(i, n, t, m.n_rows) for i, (n, t) in enumerate(zip(m.names, m.types, strict=True))], "position int, name string, type string, n_rows long")


def check_range(n_rows: int, from_row: int, to_row: int) -> tuple[int, int]:
    """(first ordinal, length) of the 1-based inclusive range; to_row -1 reads to the end, and what is past the end is cut off."""
    if n_rows:
        if from_row < 1:
            raise RowRangeError(NOT_POSITIVE)
        if from_row > n_rows:
            raise RowRangeError(OUT_OF_RANGE)
    if to_row != -1 and to_row < from_row:
        raise RowRangeError(BAD_RANGE)
    last = n_rows if to_row == -1 else min(to_row, n_rows)
    return from_row - 1, max(last - from_row + 1, 0)


def resolve(names: list[str], wanted: list[str] | None) -> list[str]:
    """Exact, case-sensitive names in the order asked for; repeats are allowed."""
    if wanted is None:
        return names
    for w in wanted:
        if w not in names:
            raise ColumnNotFound(w)
    return list(wanted)


def key_index(keys: list[str], selected: list[str]) -> list[int]:
    """Positions in the selection of the longest beginning of the keys that lies in it."""
    out = []
    for k in keys:
        if k not in selected:
            break
        out.append(selected.index(k))
    return out


def _bare_ordinals(raw: DataFrame) -> DataFrame:
    """Ordinals of a foreign dataset: row index in the file plus the rows of the files before it, by path."""
    at = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__file").alias("__in"), (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"))
    return at.join(before, F.col("__file") == F.col("__in")).select(*[f"`{c}`" for c in raw.columns], (F.col("__before") + F.col("__at")).alias(ROW))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, from_row: int = 1, to_row: int = -1, in_order: bool = False) -> DataFrame:
    """Read *columns* of the rows from_row .. to_row (1-based, inclusive).

    Errors come in this order: the table, the columns, the range. The result
    is lazy; with *in_order* it is sorted by ordinal, else it comes as stored.
    """
    raw, head = _open(spark, path)
    names, stored = _logical(raw, head)
    chosen = resolve(names, columns)
    whole = from_row == 1 and to_row == -1
    if not whole:
        parts = extents(spark, path, raw) if ROW in raw.columns else None
        first, length = check_range(sum(n for _, n in parts) if parts is not None else raw.count(), from_row, to_row)
        low, high = (first, first + length) if parts is None else _interval(parts, first, length)
    if ROW not in raw.columns and (in_order or not whole):
        raw = _bare_ordinals(raw)
    rows = raw
    if not whole:
        rows = rows.where((F.col(ROW) >= low) & (F.col(ROW) < high))
    if in_order:
        rows = rows.orderBy(ROW)
    return rows.select(*[F.col(f"`{stored[c]}`").alias(c, metadata=raw.schema[stored[c]].metadata) for c in chosen])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
