"""Seconds of zone-less timestamps: all interval arithmetic is on whole seconds since 1970, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 0001-01-01 to 1970-01-01; buckets of any width are floored from the former.
YEAR_ONE = 62135596800


def seconds(ts: str) -> Column:
    """Whole seconds of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('SECOND', {ts}))")


def moment(s: Column) -> Column:
    """The TIMESTAMP_NTZ of whole seconds."""
    return F.timestamp_add("SECOND", s, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def bucket(s: Column, width: int) -> Column:
    """Start second of the bucket of that width, floored from the year one."""
    return s - F.pmod(s + F.lit(YEAR_ONE), F.lit(width))


def ratio(over: Column, under: Column, scale: float = 1.0) -> Column:
    """scale * over / under, 0 where there is nothing to divide by."""
    return F.when(under != 0, F.lit(scale) * over / under).otherwise(F.lit(0.0))
