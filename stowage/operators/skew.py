"""Joining and numbering that stay parallel when one key holds a third of the rows.

``attach`` gives every row the values of its group; ``number_rows`` numbers rows inside
their group.  Both follow one plan at every size: a join deals a key into as many parts as
the largest group needs, numbers come from a range-partitioned total order in which a group
may lie in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.operators.scratch import counted, fact, is_saved, row_count, save

#: Rows of one group that a single task may sort or join.
GROUP_ROWS = 1_000_000
#: Rows below which sorting is not worth another task.
LEAST_ROWS = 25_000

_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition, then row in it


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    count: str,
    how: str = "inner",
    group_rows: int | None = None,
) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per key, its row count in ``count``).

    The rows of a key are dealt into parts of at most about ``group_rows`` rows; the parts
    (one row each) get the values of their group first, then every row joins its part.  Nothing
    is broadcast.  With one part a key this is the plain join.  Rows without a key, which
    match nothing, are spread as well.  ``how`` is 'inner' or 'left'; for 'left',
    ``groups`` holds every key that many rows share.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    keys = list(keys)
    # The salt is read from the table: as a literal it would be folded out of the join key.
    groups = save(groups.withColumn("_salt", F.lit(0)), "groups", largest=F.max(count))
    largest = fact(groups, "largest", F.max(count)) or 0
    parts = max(1, -(-2 * largest // group_rows) if largest > group_rows else 1)
    if parts > 1 and not is_saved(rows):
        rows = save(rows)

    hashable = [name for name, kind in rows.dtypes if "map<" not in kind]
    spread = F.xxhash64(*hashable)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    if parts == 1 and how == "inner":
        return rows.join(groups.drop("_salt"), keys)
    salt = F.when(no_key, -1 - F.pmod(spread, F.lit(1 << 16)))
    salted = rows.withColumn("_salt", salt.otherwise(F.pmod(spread, F.lit(parts))))
    if parts > 1:
        dealt = salted.filter(~no_key).select(*keys, "_salt").distinct()
        groups = dealt.join(groups.drop("_salt"), keys)
    return salted.join(groups, [*keys, "_salt"], how).drop("_salt")


def sort_tasks(spark: SparkSession, total: int, task_rows: int) -> int:
    """Tasks that sort ``total`` rows: at most ``task_rows`` each, and as many as the session uses if each of these has
    some work (a range partitioning into one task needs no sample)."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(total // task_rows + 1, min(usual, total // LEAST_ROWS + 1))


def _placed(rows: DataFrame, order: Sequence[Column], task_rows: int) -> DataFrame:
    """Rows in their total order: ``_block`` (the task) and ``_at`` (ascending in it)."""
    tasks = sort_tasks(rows.sparkSession, row_count(rows), task_rows)
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = save(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return placed.withColumn("_block", F.shiftright("_at", _LOCAL_BITS))


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    group_rows: int | None = None,
) -> DataFrame:
    """Number rows from 1 inside each group of ``keys`` (all rows if empty).

    Rows are range-partitioned by keys and order, sorted, and written with their place.  A group
    that lies in several tasks is numbered in each of them; the first group of a task then
    adds its rows in earlier tasks, from a table of at most two rows a task.  Pass narrow
    rows: they are saved, unless they are a saved table.
    """
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    rows = rows if is_saved(rows) else save(rows, rows=counted())
    columns = [*rows.columns, out]
    placed = _placed(rows, [*[F.col(k) for k in keys], *order], group_rows)
    placed = placed.withColumn("_key", F.struct(*keys) if keys else F.lit(0))

    # rows of the first and the last group of every task, and what lies before them
    ends = placed.groupBy("_block").agg(
        F.min_by("_key", "_at").alias("_first"), F.max_by("_key", "_at").alias("_last")
    )
    ends = F.broadcast(ends)  # one row per task
    pieces = placed.join(ends, "_block").filter("_key <=> _first or _key <=> _last")
    pieces = pieces.groupBy("_block", "_key").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_from")
    )
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = F.col("_from").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    bases = pieces.filter(local == 0).select("_block", "_base")

    inside = F.row_number().over(Window.partitionBy("_block", "_key").orderBy("_at")).cast("bigint")
    numbered = placed.withColumn("_row", inside).join(F.broadcast(bases), "_block")
    first = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)) == F.col("_row") - 1
    number = F.col("_row") + F.when(first, F.col("_base")).otherwise(0)
    return numbered.withColumn(out, number).select(*columns)
