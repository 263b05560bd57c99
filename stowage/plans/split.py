"""Divide one directory into batches below a size, and put batches back together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import names, sizes
from stowage.operators import collisions, filters, packing
from stowage.plans.common import moves_plan
from stowage.schema import NAME_BYTES


def _held(existing: DataFrame | None) -> DataFrame | None:
    if existing is None:
        return None
    return existing.select(F.col("dir").alias("directory"), "name")


def split_into_batches(
    manifest: DataFrame,
    output: str,
    max_size_gb: float = 1.0,
    existing: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Plan that moves the direct, non-empty files of a directory into its batches."""
    flat = filters.non_empty(filters.at_depth(manifest, 1)).select("path", "name", "size")
    packed = packing.pack(flat, sizes.limit_bytes(max_size_gb), group_rows=group_rows)
    placed = packed.withColumn("directory", names.batch_dir(F.col("batch"))).withColumn(
        "smaller", -F.col("size")
    )
    settled = collisions.resolve(
        placed,
        "directory",
        "name",
        ["smaller", "path"],
        "padded",
        _held(existing),
        group_rows=group_rows,
        longest=NAME_BYTES,
    )
    return moves_plan(settled, output, group_key=F.col("directory"))


def flatten_batches(
    manifest: DataFrame,
    output: str,
    existing: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Plan that moves files of direct subdirectories into ``output``."""
    nested = filters.at_depth(manifest, 2).select("path", "name", "size")
    claims = nested.withColumn("directory", F.lit("."))
    if existing is not None:
        existing = filters.at_depth(existing, 1).select(F.lit(".").alias("directory"), "name")
    settled = collisions.resolve(
        claims, "directory", "name", ["path"], "padded", existing, group_rows=group_rows, longest=NAME_BYTES
    )
    return moves_plan(settled.withColumn("directory", F.lit(None).cast("string")), output)
