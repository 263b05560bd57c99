"""Ranges of a sort key that tasks work on one after the other."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one range, ...
RANGE_ROWS = 20_000
#: ... unless there would be more ranges than this: then all are larger.
MOST_RANGES = 50_000


def first_keys(rows: DataFrame, keys: list[str], range_rows: int = RANGE_ROWS) -> list[tuple]:
    """The first key of every range of about ``range_rows`` rows, ascending; keys are not null.

    One key a range comes to the driver, at most ``MOST_RANGES``.  Rows with equal keys stay in one range.
    """
    keyed = rows.select(*keys)
    count = keyed.count()
    ranges = min(max(1, -(-count // range_rows)), MOST_RANGES)
    placed = keyed.repartitionByRange(ranges, *keys)
    least = placed.groupBy(F.spark_partition_id().alias("_part")).agg(
        F.min(F.struct(*keys)).alias("k")
    )
    return sorted({tuple(r["k"]) for r in least.collect()})


def range_of(firsts: list[tuple], key: tuple) -> int:
    """Index of the range that holds ``key``."""
    return max(0, bisect_right(firsts, key) - 1)
