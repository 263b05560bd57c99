"""Move files with given extensions into one directory per extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import names
from stowage.operators import batching, collisions, duplicates, filters
from stowage.operators.scratch import save
from stowage.plans.common import as_plan, moves_plan
from stowage.schema import NAME_BYTES


def organize_by_extension(
    manifest: DataFrame,
    extensions: list[str],
    output: str,
    copy: bool = False,
    free_bytes: int | None = None,
    max_files: int | None = None,
    batch_size: int = 100,
    skip_duplicates: bool = False,
    remove_source_duplicates: bool = False,
    method: str = "size",
    existing: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Plan with actions move or copy, skip, remove, skip_space, not_reached and error.

    ``existing`` is a manifest of the output directory.  Content methods need ``hash``.
    """
    if remove_source_duplicates and not skip_duplicates:
        raise ValueError("remove_source_duplicates needs skip_duplicates")
    hashed = [c for c in ("hash",) if c in manifest.columns]
    wanted = filters.with_extensions(manifest, extensions).select("path", "name", "size", "ext", *hashed)
    rows = save(wanted.withColumn("directory", names.extension_dir(F.col("ext"))), "wanted")
    held = _held(existing, extensions, hashed) if existing is not None else None

    blocked = rows.limit(0)
    if free_bytes is not None:
        gated = save(batching.space_gate(rows, free_bytes, copy, group_rows), "gated")
        blocked, rows = gated.filter("not fits").drop("fits"), gated.filter("fits").drop("fits")
    blocked = blocked.withColumn("action", F.lit("skip_space"))
    rows = batching.chunk(rows, batch_size, group_rows=group_rows)
    if skip_duplicates:
        before = held if held is not None else rows.limit(0)
        rows = duplicates.mark_incoming(
            rows, before, "directory", method, remove=remove_source_duplicates, group_rows=group_rows
        )
    else:
        rows = rows.withColumn("action", F.lit("move"))
    rows = batching.cap_moves(rows, max_files, group_rows=group_rows)
    rows = save(
        rows.withColumn("action", F.when(F.col("admitted"), F.col("action")).otherwise("not_reached")),
        "actions",
    )

    moved = collisions.resolve(
        rows.filter("action = 'move'").select("path", "name", "size", "ext", "directory"),
        "directory",
        "name",
        ["path"],
        "plain",
        existing=held,
        group_rows=group_rows,
        longest=NAME_BYTES,
    )
    done = moves_plan(moved, output, group_key=F.col("ext"), action="copy" if copy else "move")
    stay = rows.filter("action <> 'move'").select("path", "action", "size", "ext").unionByName(
        blocked.select("path", "action", "size", "ext")
    )
    return done.unionByName(as_plan(stay, group_key=F.col("ext")))


def _held(existing: DataFrame, extensions: list[str], hashed: list[str]) -> DataFrame:
    """Direct entries of the directories that files can go to."""
    targets = [f"{e}_files" for e in names.normalize_extensions(extensions)]
    return existing.filter(F.col("dir").isin(targets)).select(
        F.col("dir").alias("directory"), "name", "size", *hashed
    )


def output_directories(manifest: DataFrame, extensions: list[str], output: str) -> DataFrame:
    """One directory per extension asked for, with or without files."""
    from stowage.operators.counting import extension_list

    listed = extension_list(manifest.sparkSession, extensions)
    return listed.select(names.under(output, names.extension_dir(F.col("ext"))).alias("directory"))
