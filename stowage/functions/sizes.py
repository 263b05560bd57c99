"""Byte counts for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1024, 1024**2, 1024**3
_UNITS = ["B", "KB", "MB", "GB", "TB"]


def limit_bytes(gb: float) -> int:
    """A limit in GB as whole bytes; fractions of a byte are dropped."""
    return int(gb * GIB)


def gigabytes(size: Column) -> Column:
    return size / F.lit(float(GIB))


def megabytes(size: Column) -> Column:
    return size / F.lit(float(MIB))


def percent(part: Column, whole: Column) -> Column:
    return part / whole * 100


def human_unit(size: Column) -> Column:
    """Unit in which the number stays below 1024, PB at most."""
    expr = F.lit("PB")
    for power in reversed(range(len(_UNITS))):
        expr = F.when(size < float(1024 ** (power + 1)), F.lit(_UNITS[power])).otherwise(expr)
    return expr


def human_value(size: Column) -> Column:
    expr = size / F.lit(float(1024**5))
    for power in reversed(range(len(_UNITS))):
        scaled = size / F.lit(float(1024**power))
        expr = F.when(size < float(1024 ** (power + 1)), scaled).otherwise(expr)
    return expr


def human_bytes(size: Column) -> Column:
    return F.format_string("%.1f %s", human_value(size), human_unit(size))
