"""Batches of a fixed number of files per extension, a cap on moves, a check of space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.scratch import is_saved, save
from stowage.operators.skew import attach, number_rows


def chunk(
    rows: DataFrame,
    batch_size: int,
    group: Sequence[str] = ("ext",),
    path: str = "path",
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``chunk``, from 0: slices of ``batch_size`` files per group, in path order."""
    numbered = number_rows(rows, group, [F.col(path)], "_rn", group_rows)
    return numbered.withColumn("chunk", F.expr(f"(_rn - 1) div {int(batch_size)}")).drop("_rn")


def cap_moves(
    rows: DataFrame,
    max_files: int | None,
    path: str = "path",
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``admitted``: the cap is tested before a chunk starts, so chunks stay whole.

    ``rows`` hold ext, chunk and action; extensions are served in ascending order.  The
    chunk with the ``max_files``-th move is the last one admitted.  0 and None: no cap.
    """
    if not max_files:
        return rows.withColumn("admitted", F.lit(True))
    rows = save(rows, "chunks")
    moves = rows.filter("action = 'move'")
    ranked = number_rows(moves.select("ext", "chunk", path), ["ext"], [F.col(path)], "_rn", group_rows)
    # One row per extension asked for.
    before = Window.orderBy("ext").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        moves.groupBy("ext")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    last = (
        starts.filter((F.col("_start") < max_files) & (F.col("_start") + F.col("_n") >= max_files))
        .join(ranked, "ext")
        .filter(F.col("_start") + F.col("_rn") == max_files)
        .select("ext", "chunk")
        .first()
    )
    if last is None:
        return rows.withColumn("admitted", F.lit(True))
    within = (F.col("ext") < last.ext) | ((F.col("ext") == last.ext) & (F.col("chunk") <= last.chunk))
    return rows.withColumn("admitted", within)


def required_bytes(rows: DataFrame, copy: bool = False) -> DataFrame:
    """(ext, files, total, required): copies need a tenth more than they hold, moves a tenth."""
    total = F.coalesce(F.sum("size"), F.lit(0)).alias("total")
    factor = 1.1 if copy else 0.1
    sums = rows.groupBy("ext").agg(F.count("*").alias("files"), total)
    return sums.withColumn("required", F.col("total") * F.lit(factor))


def space_gate(
    rows: DataFrame, free_bytes: int, copy: bool = False, group_rows: int | None = None
) -> DataFrame:
    """Add ``fits``: an extension whose files need more than is free is left out whole.

    The rows are written once if they are not a saved table, so their source is read once.
    """
    rows = rows if is_saved(rows) else save(rows, "gate")
    need = required_bytes(rows, copy).select(
        "ext", "files", (F.col("required") <= F.lit(float(free_bytes))).alias("fits")
    )
    return attach(rows, need, ["ext"], "files", group_rows=group_rows).drop("files")
