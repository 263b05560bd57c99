"""Directories a plan leaves empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import names


def ancestors(directory: Column) -> Column:
    """The directory and everything above it below the root: 'a/b' -> ['a', 'a/b']."""
    parts = F.split(directory, "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    return F.when(
        directory != "", F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ).otherwise(F.array().cast("array<string>"))


def directories_of(rel_path: DataFrame, column: str = "rel_path") -> DataFrame:
    """All directories that hold a file at any depth.

    Parents are made distinct before they are exploded, so the rows that leave a task
    follow the number of directories, not of files.
    """
    parents = rel_path.select(names.parent_of(F.col(column)).alias("dir")).distinct()
    return parents.select(F.explode(ancestors(F.col("dir"))).alias("dir")).distinct()


def left_empty(directories: DataFrame, remaining: DataFrame) -> DataFrame:
    """Directories (``dir``, relative) without any remaining entry below them; never the root."""
    return directories.select("dir").filter("dir <> ''").distinct().join(
        directories_of(remaining), "dir", "left_anti"
    )
