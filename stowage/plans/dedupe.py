"""Keep one copy of every file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators import duplicates, filters
from stowage.operators.scratch import save
from stowage.plans.common import as_plan
from stowage.sources import digests


def dedupe(
    hashed: DataFrame, strategy: str = "shortest_path", group_rows: int | None = None
) -> DataFrame:
    """Plan (keep, remove, error) for rows with path, size, mtime and hash."""
    marked = duplicates.mark_duplicates(hashed, strategy, group_rows)
    reason = F.when(F.col("action") == "remove", F.concat(F.lit("copy of "), "keep_path")).when(
        F.col("action") == "error", F.lit("unreadable")
    )
    return as_plan(marked, reason=reason, group_key=F.col("hash"))


def dedupe_files(
    manifest: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    algorithm: str = "sha256",
    strategy: str = "shortest_path",
    every_digest: bool = False,
) -> DataFrame:
    """Plan for files on disk.  Names are filtered before any byte is read, and only files
    that share their size with another one are hashed, unless every digest is wanted."""
    chosen = filters.exclude_globs(filters.include_globs(manifest, include), exclude)
    chosen = save(chosen.select("path", "size", "mtime"), "chosen")
    to_hash = chosen if every_digest else save(digests.same_size_only(chosen), "same_size")
    hashed = save(digests.hash_files(to_hash, algorithm), "digests")
    plan = dedupe(hashed, strategy)
    if every_digest:
        return plan
    sized = chosen.filter("size is not null")
    alone = sized.groupBy("size").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1")
    return plan.unionByName(as_plan(alone.withColumn("action", F.lit("keep"))))


def dedupe_contents(
    manifest: DataFrame, content: str, algorithm: str = "sha256", strategy: str = "shortest_path"
) -> DataFrame:
    """Plan for a table that carries its contents; they are read once."""
    hashed = manifest.select(
        "path", "size", "mtime", digests.digest(F.col(content), algorithm).alias("hash")
    )
    return dedupe(save(hashed, "digests"), strategy)
