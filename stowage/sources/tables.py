"""A manifest from any table: documents, pages, an inventory export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import names


def from_table(
    table: DataFrame,
    rel_path: Column,
    size: Column | None = None,
    mtime: Column | None = None,
    root: str = "",
    **extra: Column,
) -> DataFrame:
    """Manifest columns computed from a table; ``extra`` columns are carried along."""
    rel = table.select(
        rel_path.alias("rel_path"),
        (F.lit(None) if size is None else size).cast("bigint").alias("size"),
        (F.lit(None).cast("timestamp") if mtime is None else mtime).alias("mtime"),
        *[column.alias(alias) for alias, column in extra.items()],
    )
    path = names.under(root, F.col("rel_path"))
    return rel.select(
        path.alias("path"),
        "rel_path",
        names.parent_of(F.col("rel_path")).alias("dir"),
        names.name_of(F.col("rel_path")).alias("name"),
        F.lit("file").alias("kind"),
        "size",
        "mtime",
        names.depth_of(F.col("rel_path")).alias("depth"),
        *extra,
    )
