"""Exact copies: which files are copies of each other, and which one stays."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import names
from stowage.operators.skew import attach, number_rows

KEEP_STRATEGIES = ("shortest_path", "oldest", "newest", "largest_name", "first_alphabetical")

_LATEST = (1 << 63) - 1


def _keep_rank(strategy: str) -> Column:
    """The file with the lowest rank stays; equal ranks go by path."""
    modified = F.unix_micros(F.col("mtime").cast("timestamp"))
    if strategy == "oldest":
        return F.coalesce(modified, F.lit(_LATEST))
    if strategy == "newest":
        return F.coalesce(-modified, F.lit(_LATEST))
    if strategy == "largest_name":
        return -F.length(names.name_of(F.col("path")))
    if strategy == "first_alphabetical":
        return F.lower("path")
    if strategy != "shortest_path":
        warnings.warn(f"no way to choose the kept file is called {strategy!r}; shortest_path decides", stacklevel=3)
    return F.length("path")


def duplicate_sets(digests: DataFrame, strategy: str = "shortest_path") -> DataFrame:
    """One row per set of equal files: hash, n, keep_path, bytes and freed bytes.

    The keeper is an aggregate, not the first row of a sorted group, so a set that holds
    a third of all files is reduced inside every task before the shuffle.  Files without
    a digest belong to no set.
    """
    best = F.min(F.struct(_keep_rank(strategy).alias("rank"), "path", "size"))
    return (
        digests.filter("hash is not null")
        .groupBy("hash")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), best.alias("best"))
        .filter("n > 1")
        .select(
            "hash",
            "n",
            F.col("best.path").alias("keep_path"),
            "bytes",
            (F.col("bytes") - F.col("best.size")).alias("freed_bytes"),
        )
    )


def mark_duplicates(
    digests: DataFrame, strategy: str = "shortest_path", group_rows: int | None = None
) -> DataFrame:
    """Every file with its ``action``: keep, remove, or error if it has no digest."""
    sets = duplicate_sets(digests, strategy).select("hash", "n", "keep_path")
    known = attach(digests, sets, ["hash"], "n", "left", group_rows)
    action = (
        F.when(F.col("hash").isNull(), "error")
        .when(F.col("path") != F.col("keep_path"), "remove")
        .otherwise("keep")
    )
    return known.withColumn("action", action)


def set_members(
    digests: DataFrame, strategy: str = "shortest_path", group_rows: int | None = None
) -> DataFrame:
    """Files of duplicate sets only, with the size of their set and its keeper."""
    sets = duplicate_sets(digests, strategy).select("hash", "n", "keep_path")
    return attach(digests, sets, ["hash"], "n", "inner", group_rows)


def totals(digests: DataFrame) -> DataFrame:
    """One row: files, unique digests, sets, files to remove and bytes they free."""
    rank = F.min(F.struct(F.length("path"), "path", "size"))
    per_hash = (
        digests.filter("hash is not null")
        .groupBy("hash")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), rank.alias("best"))
    )
    copies = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)
    freed = F.when(F.col("n") > 1, F.col("bytes") - F.col("best.size")).otherwise(0)
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.count("*").alias("unique_hashes"),
        F.count_if(F.col("n") > 1).alias("duplicate_sets"),
        F.coalesce(F.sum(copies), F.lit(0)).alias("to_remove"),
        F.coalesce(F.sum(freed), F.lit(0)).alias("freed_bytes"),
    )


def numbered_sets(sets: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Sets numbered from 1 in digest order."""
    return number_rows(sets, [], [F.col("hash")], "set_no", group_rows)


def against_digests(
    digests: DataFrame, known: DataFrame, group_rows: int | None = None
) -> DataFrame:
    """Flag files whose digest a saved table holds, as ``known``."""
    per_hash = digests.filter("hash is not null").groupBy("hash").agg(F.count("*").alias("_n"))
    seen = known.select("hash").distinct().withColumn("known", F.lit(True))
    flags = per_hash.join(seen, "hash", "left")
    return (
        attach(digests, flags, ["hash"], "_n", "left", group_rows)
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .drop("_n")
    )


# -- copies among incoming files -------------------------------------------------------

MATCH_METHODS = {"size": ["size"], "hash": ["hash"], "both": ["size", "hash"]}


def mark_incoming(
    incoming: DataFrame,
    existing: DataFrame,
    directory: str,
    method: str = "size",
    order: str = "path",
    remove: bool = False,
    vs_existing_only: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``action``: move, or skip (remove) for copies of what the target will hold.

    A file is a copy if its target directory has a file with the same key, from before
    (``existing``) or from an earlier row of this run.  ``size`` alone may match files
    that differ.  A null key matches nothing and gives 'error'.
    """
    keys = [directory, *MATCH_METHODS[method]]
    usable = F.lit(True)
    for key in MATCH_METHODS[method]:
        usable = usable & F.col(key).isNotNull()
    first = incoming.filter(usable).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min(order).alias("_first")
    )
    held = existing.select(*keys).distinct().withColumn("_held", F.lit(True))
    facts = first.join(held, keys, "left")
    known = attach(incoming, facts, keys, "_n", "left", group_rows)
    copy = F.col("_held").isNotNull()
    if not vs_existing_only:
        copy = copy | (F.col(order) != F.col("_first"))
    action = (
        F.when(~usable, "error").when(copy, "remove" if remove else "skip").otherwise("move")
    )
    return known.withColumn("action", action).select(*incoming.columns, "action")
