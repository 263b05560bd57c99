"""Sequential rules over sorted groups that stay parallel inside a group.

A rule carries a state from row to row of a group.  ``scan`` sorts all rows into ranges.  A group that lies in
one range is folded there from the starting state.  A group that goes on in other ranges gives, for
each of them, a summary: what the range does to any state.  Summaries (at most two a range) are applied one
after the other, which names the state every range starts from, and the ranges are then folded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.operators.scratch import counted, is_saved, row_count, save
from stowage.operators.skew import sort_tasks

#: Rows that one task sorts and folds.
RANGE_ROWS = 200_000

Rows = list[tuple]


class Rule:
    """A sequential rule over rows given as tuples of the columns named in ``reads``."""

    #: Columns the rule reads.
    reads: Sequence[str]
    #: Columns it adds to every row.
    adds: T.StructType
    #: State before the first row.
    start: Any = None

    def fold(self, state: Any, rows: Rows) -> list[tuple]:
        """The added columns of every row."""
        raise NotImplementedError

    def summary(self, rows: Rows) -> Any:
        """What ``rows`` do to any state; its size should not depend on their number more than it must."""
        raise NotImplementedError

    def advance(self, state: Any, summary: Any) -> Any:
        """The state after rows that have this summary; a state's size does not grow with the rows."""
        raise NotImplementedError


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _segments(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where groups begin, and the number of rows."""
    if not keys:
        return [0, table.num_rows]
    values = list(zip(*[table[k].to_pylist() for k in keys]))
    return [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]] + [len(values)]


def _columns(found: list, schema: T.StructType) -> list[pa.Array]:
    arrow = _arrow(schema)
    return [pa.array([None if r is None else r[i] for r in found], f.type) for i, f in enumerate(arrow)]


def scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rule: Rule,
    range_rows: int | None = None,
    cut: Sequence[Column] | None = None,
) -> DataFrame:
    """Add the columns of ``rule`` to ``rows``, folded along ``order`` inside each group of ``keys``.

    Pass narrow rows: they are written twice, and those of a range (about ``range_rows``) are held by one task.
    Rows that agree in keys and order may be folded in any order.  Ranges are cut along ``order``, or along
    ``cut``, of which order must be a refinement: rows that agree in it stay together.
    """
    range_rows = range_rows or RANGE_ROWS
    keys = list(keys)
    rows = rows if is_saved(rows) else save(rows, "scanned", rows=counted())
    tasks = sort_tasks(rows.sparkSession, row_count(rows), range_rows)
    by = [*[F.col(k) for k in keys], *order]
    along = by if cut is None else [*by[: len(keys)], *cut]
    ranges = rows.repartitionByRange(tasks, *along).sortWithinPartitions(*by)
    ranges = ranges.select(
        *rows.columns,
        F.spark_partition_id().cast("long").alias("_range"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = T.StructType(ranges.schema.fields + rule.adds.fields)
    walked = T.StructType(
        placed.fields + [T.StructField("_open", T.BooleanType()), T.StructField("_summary", T.BinaryType())]
    )
    names, own = list(rule.reads), list(rows.columns)

    def tuples(table: pa.Table) -> Rows:
        return list(zip(*[table[c].to_pylist() for c in names]))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        starts, read = _segments(table, keys), tuples(table)
        last = len(starts) - 2
        found: list = []
        summaries: list = [None] * table.num_rows
        for i, (low, high) in enumerate(zip(starts, starts[1:])):
            if i in (0, last):
                summaries[low] = cloudpickle.dumps(rule.summary(read[low:high]))
                found += [None] * (high - low)
            else:
                found += rule.fold(rule.start, read[low:high])
        out = table.columns + _columns(found, rule.adds)
        out.append(pa.array([f is None for f in found], pa.bool_()))
        out.append(pa.array(summaries, pa.binary()))
        yield from pa.table(out, names=walked.names).to_batches(max_chunksize=10_000)

    walk = save(ranges.mapInArrow(first_pass, walked), "walked")

    ends = walk.filter("_summary is not null").select(*keys, "_range", "_summary")
    carried = T.StructType(
        [f for f in ends.schema.fields if f.name != "_summary"] + [T.StructField("_state", T.BinaryType())]
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(carried)
        now: tuple | None = None
        state = rule.start
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if now != row[:-2]:
                    now, state = row[:-2], rule.start
                out.append((*row[:-1], cloudpickle.dumps(state)))
                state = rule.advance(state, cloudpickle.loads(row[-1]))
            if out:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    # at most two rows a task, in order; all of a group in one task
    together = ends.repartition(*keys) if keys else ends.coalesce(1)
    states = together.sortWithinPartitions(*keys, "_range").mapInArrow(chain, carried)

    # a state is small, and there are at most two a task
    opened = walk.filter("_open").drop("_open", "_summary").alias("w").join(
        F.broadcast(states).alias("s"),
        [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, "_range"]],
    )
    opened = opened.select("w.*", "s._state").repartition("_range").sortWithinPartitions("_range", "_at")
    kept = own + [f.name for f in rule.adds]
    result = T.StructType([f for f in placed if f.name in kept])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_ranges(batches):
            starts, read = _segments(table, [*keys, "_range"]), tuples(table)
            found: list = []
            for low, high in zip(starts, starts[1:]):
                state = cloudpickle.loads(table["_state"][low].as_py())
                found += rule.fold(state, read[low:high])
            out = [table[c] for c in own] + _columns(found, rule.adds)
            yield from pa.table(out, names=result.names).to_batches(max_chunksize=10_000)

    rest = opened.mapInArrow(second_pass, result)
    return walk.filter("not _open").select(*kept).unionByName(rest)


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold one range each, of rows sorted by range."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        numbers = batch.column("_range").to_pylist()
        low = 0
        for i, number in enumerate(numbers):
            if number != now:
                if i > low:
                    held.append(batch.slice(low, i - low))
                if held:
                    yield pa.Table.from_batches(held)
                held, now, low = [], number, i
        if numbers:
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)
