"""Column attributes, scales and annotations, kept in the metadata of fields, and the values they stand for."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "tabloom"


class Attribute(str, Enum):
    """What the stored values of a column mean."""

    NONE = "none"
    CHARACTER_BASE = "character"
    FACTOR_BASE = "factor"
    FACTOR_ORDERED = "ordered factor"
    INT_32_BASE = "int32"
    INT_32_TIMESTAMP_SECONDS = "int32 timestamp"
    INT_32_TIMEINTERVAL_SECONDS = "int32 interval"
    INT_32_DATE_DAYS = "int32 date"
    INT_32_TIME_OF_DAY_SECONDS = "int32 time of day"
    DOUBLE_64_BASE = "double"
    DOUBLE_64_DATE_DAYS = "double date"
    DOUBLE_64_TIMESTAMP_SECONDS = "double timestamp"
    DOUBLE_64_TIMEINTERVAL_SECONDS = "double interval"
    DOUBLE_64_TIME_OF_DAY_SECONDS = "double time of day"
    BOOL_2_BASE = "logical"
    INT_64_BASE = "int64"
    INT_64_TIME_SECONDS = "int64 time"
    BYTE_BASE = "byte"


#: Powers of ten that a stored number is to be multiplied by.
SCALES = {"pico": -12, "nano": -9, "micro": -6, "milli": -3, "none": 0, "kilo": 3, "mega": 6, "giga": 9, "tera": 12}
#: Microseconds of a unit of int64 times; nanoseconds are finer than a Spark timestamp.
TIME_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}

_TYPES = {
    "character": T.StringType(),
    "factor": T.StringType(),
    "ordered": T.StringType(),
    "int32": T.IntegerType(),
    "double": T.DoubleType(),
    "logical": T.BooleanType(),
    "int64": T.LongType(),
    "byte": T.ByteType(),
}


@dataclass(frozen=True)
class Described:
    """The description of a column: attribute, power of ten or time unit, annotation, and the levels of a factor."""

    attribute: Attribute = Attribute.NONE
    scale: int | str = 0
    annotation: str | None = None
    levels: tuple[str, ...] | None = None


def physical_type(attribute: Attribute) -> T.DataType | None:
    """The Spark type that values with this attribute are stored as."""
    return _TYPES.get(attribute.value.split()[0])


def natural(data_type: T.DataType) -> Attribute:
    """The attribute of a column that has not been described."""
    for a in (Attribute.CHARACTER_BASE, Attribute.INT_32_BASE, Attribute.DOUBLE_64_BASE, Attribute.BOOL_2_BASE, Attribute.INT_64_BASE, Attribute.BYTE_BASE):
        if data_type == physical_type(a):
            return a
    return Attribute.NONE


def describe(df: DataFrame, column: str, what: Described) -> DataFrame:
    """Attach a description; values stay as they are. The stored type must be the attribute's."""
    expected = physical_type(what.attribute)
    if expected is not None and df.schema[column].dataType != expected:
        raise ValueError(f"column '{column}' is {df.schema[column].dataType.simpleString()}, attribute {what.attribute.value} needs {expected.simpleString()}")
    kept = {"attribute": what.attribute.name, "scale": what.scale}
    if what.annotation is not None:
        kept["annotation"] = what.annotation
    if what.levels is not None:
        kept["levels"] = list(what.levels)
    return df.withMetadata(column, {**df.schema[column].metadata, KEY: kept})


def description(field: T.StructField) -> Described:
    """The description of a field; the natural one where none is attached."""
    kept = (field.metadata or {}).get(KEY)
    if not kept or "attribute" not in kept:
        return Described(natural(field.dataType))
    levels = kept.get("levels")
    return Described(Attribute[kept["attribute"]], kept.get("scale", 0), kept.get("annotation"), None if levels is None else tuple(levels))


def meaning(df: DataFrame, column: str) -> Column:
    """The values a described column stands for: dates, timestamps, intervals, times, scaled numbers.

    NULL stays NULL. Nanosecond times have no lossless Spark type and raise an error.
    """
    d, c = description(df.schema[column]), F.col(column)
    power = d.scale if isinstance(d.scale, int) else 0
    scaled = c * F.lit(10.0**power) if power else c
    kind = d.attribute.value
    if kind.endswith("date"):
        return F.date_from_unix_date(F.floor(c).cast("int"))
    if kind.endswith("of day"):
        # As text: sessions may have the TIME type switched off, and Parquet cannot hold it.
        return F.date_format(F.timestamp_seconds(F.pmod(F.floor(c), F.lit(86_400))).cast("timestamp_ntz"), "HH:mm:ss")
    if kind.endswith("timestamp"):
        return F.timestamp_micros(F.round(scaled * 1_000_000).cast("long"))
    if kind.endswith("interval"):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), scaled.cast("decimal(18,6)"))
    if d.attribute is Attribute.INT_64_TIME_SECONDS:
        if d.scale not in TIME_UNITS:
            raise ValueError(f"times in units of {d.scale!r} have no lossless timestamp")
        return F.timestamp_micros(c * TIME_UNITS[d.scale])
    return scaled
