"""Nanosecond time keys.  Spark timestamps end at microseconds, so keys are 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def ns_of_ntz(column: str) -> Column:
    """UTC nanoseconds of a timestamp without time zone, whatever the session's zone."""
    d = f"({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    seconds = f"(extract(DAY FROM {d}) * 86400L + extract(HOUR FROM {d}) * 3600L + extract(MINUTE FROM {d}) * 60L)"
    return F.expr(f"({seconds} * 1000000L + CAST(extract(SECOND FROM {d}) * 1000000 AS BIGINT)) * 1000L")


def timestamp_of_ns(column: Column) -> Column:
    return F.timestamp_micros(floor_div(column, 1000))


def date_of_ns(column: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(column, DAY).cast("int"))


def floor_div(column: Column, by: int | Column) -> Column:
    """Integer division towards minus infinity; exact for all longs."""
    by = F.lit(by).cast("long") if isinstance(by, int) else by
    return F.call_function("div", column - F.pmod(column, by), by)


def local_hour(column: Column, offset_hours: int) -> Column:
    """Hour of day, with fraction, at a fixed offset from UTC."""
    return F.pmod(column + F.lit(offset_hours * HOUR).cast("long"), F.lit(DAY).cast("long")) / F.lit(float(HOUR))
