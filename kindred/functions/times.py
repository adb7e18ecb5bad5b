"""Timestamps are UTC instants; equality and order work on microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_utc(name: str, dtype: T.DataType) -> Column:
    """Instant from a timestamp, zone-less timestamp, date or ISO string; null if unreadable."""
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c)
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        # A bare number counts nanoseconds since the epoch.
        return F.timestamp_micros((c / 1000).cast("bigint"))
    if isinstance(dtype, T.TimestampNTZType):
        # Zone-less values are UTC whatever the session zone is.
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return c.cast("timestamp")


def from_unix_seconds(value: Column) -> Column:
    return F.timestamp_micros((value.cast("double") * F.lit(1e6)).cast("bigint"))


def micros(value: Column) -> Column:
    return F.unix_micros(value)


def iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
