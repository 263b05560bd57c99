"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.scratch import save

#: Parts a group of equal keys is dealt into before a join.
SALTS = 1024
#: Words of 64 bits in the bit vector of ``marked``.
BITS = 1 << 16


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name; others, whatever they are called, are left out."""
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def whole_rows(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``_row``, a struct of all columns by position."""
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    named = [F.col(f"_c{df.columns.index(n)}").alias(n) for n in names]
    return flat.select(*named, F.struct(*flat.columns).alias("_row"))


def unpack_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undo ``whole_rows``: the columns as they were."""
    return df.select(*[F.col(f"_row._c{i}").alias(n) for i, n in enumerate(columns)])


def dense(spark: SparkSession, rows: DataFrame, size: int, kind: str) -> DataFrame:
    """One row with an array of ``size`` values; ``rows`` are (at, value), others 0."""
    places = spark.range(size).select(F.col("id").alias("at"))
    value = F.coalesce("value", F.lit(0)).cast(kind).alias("value")
    filled = places.join(rows, "at", "left").select("at", value)
    pairs = F.sort_array(F.collect_list(F.struct("at", "value")))
    return filled.agg(pairs.getField("value").alias("all"))


def marked(hashes: DataFrame) -> Callable[[str], Column]:
    """A test that holds for every value of ``hash`` and for few others; it takes the SQL of a hash."""
    place = F.pmod("hash", F.lit(BITS * 64))
    marks = hashes.select(F.floor(place / 64).cast("long").alias("at"), F.pmod(place, F.lit(64)).alias("bit"))
    marks = marks.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("value"))
    name = f"_stowage_marks_{uuid.uuid4().hex[:8]}"
    save(dense(hashes.sparkSession, marks, BITS, "long"), "marks").createOrReplaceTempView(name)

    def bit_set(value: str) -> Column:
        return F.expr(
            f"shiftrightunsigned(element_at((select first(all) from {name}),"
            f" cast(pmod({value}, {BITS * 64}) div 64 as int) + 1), cast(pmod({value}, 64) as int)) & 1 = 1"
        )

    return bit_set


def attach(rows: DataFrame, groups: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Left join of ``groups`` (one row per ``key``) for keys that any number of rows share.

    A key's rows are dealt into at most ``SALTS`` parts by the columns ``spread``.  The parts
    of a key get its values first (at most ``SALTS`` rows a key), then every row joins its part.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("_salt", salt)
    parts = rows.select(key, "_salt").filter(F.col(key).isNotNull()).distinct()
    return rows.join(parts.join(groups, key), [key, "_salt"], "left").drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b): root is the smallest reachable.

    Alternating large and small stars: every round points nodes at smaller neighbours, and
    the number of rounds grows with the logarithm of the longest path.  Neighbours of a node
    are only aggregated and joined, so a node may have any number of them.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = save(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


#: Rows that one call of a function under ``by_batch`` gets.
BATCH_ROWS = 1000


def by_batch(function: Callable, *constants) -> Callable:
    """For mapInArrow: ``function`` makes one record batch of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield function(batch.slice(start, BATCH_ROWS), *constants)

    return run


def groups(
    batches: Iterable[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of equal ``keys``, and the bounds of the groups in them.

    The batches are sorted by ``keys``, which are not null.  The last group of a batch waits
    for the next one.
    """
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            values = table[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        found = bounds(table)
        held = table.slice(found[-2])
        if len(found) > 2:
            yield table.slice(0, found[-2]).combine_chunks(), found[:-1]
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def cells(rows: DataFrame, size: Column, limit: int, spread: str) -> DataFrame:
    """Rows of groups dealt into cells, so that every two rows of a group meet in one cell.

    A group of ``size`` rows is cut into chunks of about ``limit`` rows; a cell holds two of
    its chunks (``_i`` <= ``_j``, ``_own`` tells which one the row belongs to).  A group of up
    to ``limit`` rows is one cell.
    """
    chunks = F.ceil(size / F.lit(limit)).cast("int")
    rows = rows.withColumn("_chunks", chunks).withColumn(
        "_own", F.pmod(F.xxhash64(spread), F.col("_chunks")).cast("int")
    )
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return (
        rows.withColumn("_i", F.least("_own", "_with"))
        .withColumn("_j", F.greatest("_own", "_with"))
        .drop("_with", "_chunks")
    )
