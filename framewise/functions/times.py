"""Time columns: whole milliseconds or Spark timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_millis(df: DataFrame, name: str) -> bool:
    """True for a whole-number millisecond column, False for a timestamp."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return True
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return False
    raise TypeError(f"{name} must be whole milliseconds or a timestamp, not {kind.simpleString()}")


def millis_interval(millis: int) -> Column:
    return F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(millis / 1000).cast("decimal(18,6)")
    )


def add_millis(column: Column, millis: int, as_millis: bool) -> Column:
    if as_millis:
        return column + F.lit(millis).cast("long")
    return column + millis_interval(millis)


def to_timestamp(column: Column, as_millis: bool) -> Column:
    return F.timestamp_millis(column) if as_millis else column


def from_timestamp(column: Column, as_millis: bool) -> Column:
    return F.unix_millis(column) if as_millis else column


# Digits by which a clock value is divided to get milliseconds.
MILLIS_PER_UNIT = {
    "ps": (1, 1_000_000_000),
    "ns": (1, 1_000_000),
    "ms": (1, 1),
    "s": (1_000, 1),
}


def scale_to_millis(column: Column, unit: str) -> Column:
    """Whole milliseconds of a clock value in ``unit``; other units are kept."""
    times, by = MILLIS_PER_UNIT.get(unit, (1, 1))
    if by > 1:
        # Whole-number division truncates toward zero, as the clock values do.
        return F.call_function("div", column, F.lit(by).cast("long"))
    return column * F.lit(times).cast("long") if times > 1 else column


def scale_to_seconds(column: Column, unit: str) -> Column:
    return F.call_function("div", scale_to_millis(column, unit), F.lit(1000).cast("long"))
