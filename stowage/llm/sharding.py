"""Shards of equal size by histogram sort, in DataFrame operations only.

Rows get a key of hexadecimal digits.  Probes are key prefixes: a round counts the exact bytes
below every probe inside the prefixes that still hold a splitter, and refines these by two
digits, until each splitter is within the tolerance of its target.  Then the rows are
exchanged once, into cells that are short ranges of keys, and take their places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import pick
from stowage.operators.scratch import save

_DIGITS = 2
_LENGTH = 32
#: Rows a cell of keys may hold on average.
CELL_ROWS = 50_000


def _refine(rows: DataFrame, shards: int, tolerance: int) -> tuple[list[str], dict[str, int]]:
    """Splitters (key prefixes; a shard ends below its splitter) and facts about the rows."""
    total, count, largest = rows.agg(F.sum("size"), F.count("*"), F.max("size")).first()
    if not count:
        return [], {"rows": 0}
    targets = [total * (i + 1) // shards for i in range(shards - 1)]
    allowed = max(tolerance, 1)
    done: dict[int, str] = {}
    open_ = {"": (0, list(range(len(targets))))}  # prefix: bytes below it, splitters inside
    depth = 0
    while open_ and depth < _LENGTH:
        inside = rows
        if depth:
            inside = rows.filter(F.substring("key", 1, depth).isin(list(open_)))
        depth += _DIGITS
        probe = F.substring("key", 1, depth).alias("probe")
        counted = inside.groupBy(probe).agg(F.sum("size").alias("bytes")).collect()
        by_prefix: dict[str, list[tuple[str, int]]] = {}
        for r in sorted(counted, key=lambda r: r["probe"]):
            by_prefix.setdefault(r["probe"][:-_DIGITS], []).append((r["probe"], r["bytes"]))
        refined: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, splitters) in open_.items():
            found = by_prefix[prefix]
            for s in splitters:
                at = below
                for i, (p, held) in enumerate(found):
                    if at + held < targets[s] and i + 1 < len(found):
                        at += held
                        continue
                    after = at + held
                    if targets[s] - at <= allowed:
                        done[s] = p
                    elif after - targets[s] <= allowed:
                        done[s] = p + "g"  # behind all keys with this prefix
                    elif depth >= _LENGTH:
                        done[s] = p if targets[s] - at <= after - targets[s] else p + "g"
                    else:
                        refined.setdefault(p, (at, []))[1].append(s)
                    break
        open_ = refined
    return [done[s] for s in range(len(targets))], {"rows": count, "largest": largest}


def _digits_for(rows: int) -> int:
    """Hexadecimal digits that cut ``rows`` into cells of about CELL_ROWS."""
    return max(1, math.ceil(math.log(max(rows / CELL_ROWS, 1), 16)))


def shard(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    tolerance: float = 0.001,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row's shard and slot; shards hold nearly equal bytes.

    The law is ``bytes``: a row counts the UTF-8 bytes of its text (null: none) plus ``overhead``;
    a splitter is off its target by at most ``tolerance`` of a shard, or by one row if that
    is more.  Keys are digits of md5 of ``key``, then of a hash of key and text, and last of a hash of the row's
    place, which only parts rows that are equal; so repeated rows, rows without a key and copies of a text
    spread over shards like any others, and shards and slots of other rows don't depend on the files of the table.
    Slots count from 0 in every shard without a gap; their order is fixed, but means nothing.  ``keep`` names further columns to carry
    along, such as the text itself.  A null text has checksum 0.  An empty table gives no rows.
    """
    names = [key, text, *[k for k in keep if k not in (key, text)]]
    docs = pick(docs, *names)
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long")
    facts = docs.select(
        F.col(key).alias("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        *[F.col(k).alias(f"_keep_{i}") for i, k in enumerate(keep)],
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.monotonically_increasing_id().alias("_at"),
    )
    first = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("0" * 32))
    second = F.xxhash64(F.lit(1), "doc_id", "text_hash")
    digits = [F.left(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(8)) for h in (second, F.xxhash64("_at"))]
    facts = facts.withColumn("key", F.concat(F.substring(first, 1, 16), *digits)).drop("_at", "text_hash")
    rows = save(facts, "sizes")

    total = rows.agg(F.sum("size")).first()[0] or 0
    splitters, about = _refine(rows, shards, int(total / shards * tolerance))
    number: Column = F.lit(0)
    for s in splitters:
        number = number + (F.col("key") >= s).cast("int")
    lead = _digits_for(about["rows"])
    cell = F.substring("key", 1, lead)
    most = rows.groupBy(cell).count().agg(F.max("count")).first()[0] or 0
    cell = F.concat(cell, F.substring("key", 17, _digits_for(most)))
    # what still crowds a cell is equal rows, which their place parts
    most = rows.groupBy(cell).count().agg(F.max("count")).first()[0] or 0
    if most > 16 * CELL_ROWS:
        cell = F.concat(cell, F.substring("key", 25, _digits_for(most)))
    placed = rows.withColumn("shard", number).withColumn("_cell", cell)

    sizes = placed.groupBy("shard", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_cell").orderBy("key")
    placed = placed.withColumn("_row", F.row_number().over(inside)).join(starts, ["shard", "_cell"])
    return placed.select(
        F.col("doc_id").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_row") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_keep_{i}").alias(k) for i, k in enumerate(keep)],
    )


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Write a result of ``shard`` (with the text kept) as one folder for each shard."""
    tasks = sharded.agg(F.max("shard")).first()[0]
    if tasks is not None:
        part = F.pmod(F.xxhash64("slot"), F.lit(16))
        spread = sharded.repartition((tasks + 1) * 16, "shard", part)
        spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
