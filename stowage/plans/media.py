"""File photos, videos and music by their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import dates, names
from stowage.operators import collisions, filters, tagging
from stowage.operators.scratch import save
from stowage.plans.common import UNDATED, as_plan, moves_plan
from stowage.schema import NAME_BYTES
from stowage.sources import tags as tag_source


def _settle(
    rows: DataFrame, output: str, existing: DataFrame | None, group_rows: int | None
) -> DataFrame:
    """Plan from rows with path, size, action, reason, directory and wanted name."""
    kept = ["path", "size", "action", "reason", "directory", "wanted"]
    rows = save(rows.select(*kept), "targets")  # tags are joined and parsed once
    moves = rows.filter("action = 'move'")
    if existing is not None:
        existing = existing.select(F.col("dir").alias("directory"), F.col("name").alias("wanted"))
    settled = collisions.resolve(
        moves,
        "directory",
        "wanted",
        ["path"],
        "chained",
        existing,
        group_rows=group_rows,
        longest=NAME_BYTES,
    )
    stay = rows.filter("action <> 'move'")
    done = moves_plan(settled, output, F.col("reason"), F.col("directory"))
    return done.unionByName(as_plan(stay, reason=F.col("reason")))


def _error_flag(manifest: DataFrame) -> Column:
    failed = F.lit(False)
    if "tag_error" in manifest.columns:
        failed = F.coalesce("tag_error", F.lit(False))
    return failed


def photo_targets(
    manifest: DataFrame, tags: DataFrame, raw_make: bool = False, fallback: str | None = None
) -> DataFrame:
    """Directory and name wanted for every photo: by date, else by make, else skipped.

    ``manifest`` may carry ``tag_error``.  ``fallback='mtime'`` dates the rest by file time.
    """
    if fallback not in (None, "mtime"):
        raise ValueError("fallback is None or 'mtime'")
    facts = tagging.photo_facts(tags)
    rows = filters.media(manifest, "photo").join(facts, "path", "left")
    make = tagging.known_make(F.col("make"))
    taken = F.col("taken")
    if fallback == "mtime":
        taken = F.coalesce(taken, F.when(make.isNull(), dates.file_date(F.col("mtime"))))
    failed = _error_flag(manifest)
    action = F.when(failed, "error").when(taken.isNull() & make.isNull(), "skip").otherwise("move")
    reason = F.when(failed, "unreadable tags").when(taken.isNotNull(), "date").when(
        make.isNotNull(), "make"
    ).otherwise(UNDATED)
    directory = F.when(taken.isNotNull(), names.dated_dir(taken)).otherwise(names.make_dir(make, raw_make))
    wanted = F.when(taken.isNotNull(), names.dated_name(F.col("name"), taken)).otherwise(F.col("name"))
    return rows.select(
        "path", "name", "size", action.alias("action"), reason.alias("reason"),
        directory.alias("directory"), wanted.alias("wanted"),
    )


def organize_photos(
    manifest: DataFrame,
    tags: DataFrame,
    output: str,
    existing: DataFrame | None = None,
    raw_make: bool = False,
    fallback: str | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    return _settle(photo_targets(manifest, tags, raw_make, fallback), output, existing, group_rows)


def video_targets(manifest: DataFrame, probe: str = "probe") -> DataFrame:
    """By container date, else by file time; unreadable tags are an error, with no fallback.

    ``probe`` is a column with a container probe's JSON.
    """
    rows = tag_source.read_probe(filters.media(manifest, "video"), probe, "_tags", "_failed")
    rows = rows.withColumn("_found", dates.container_date(F.col("_tags")))
    taken = F.coalesce("_found", dates.file_date(F.col("mtime")))
    action = F.when(F.col("_failed") | taken.isNull(), "error").otherwise("move")
    reason = F.when(F.col("_failed"), "unreadable tags").when(
        F.col("_found").isNotNull(), "date"
    ).when(taken.isNotNull(), "file time").otherwise("no date")
    return rows.withColumn("_taken", taken).select(
        "path", "name", "size", action.alias("action"), reason.alias("reason"),
        names.dated_dir(F.col("_taken")).alias("directory"),
        names.dated_name(F.col("name"), F.col("_taken")).alias("wanted"),
    )


def organize_videos(
    manifest: DataFrame,
    output: str,
    probe: str = "probe",
    existing: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    return _settle(video_targets(manifest, probe), output, existing, group_rows)


def music_targets(manifest: DataFrame, tags: str = "tags") -> DataFrame:
    """Artist, album and 'NN - title' for every track; files without tags go under defaults.

    ``tags`` is a MAP<STRING, ARRAY<STRING>> column; null where no tags could be read.
    """
    rows = filters.media(manifest, "music")
    field = {f: tagging.music_field(F.col(tags), f) for f in ("artist", "album", "title", "track")}
    return rows.select(
        "path",
        "name",
        "size",
        F.lit("move").alias("action"),
        F.lit(None).cast("string").alias("reason"),
        names.music_dir(field["artist"], field["album"]).alias("directory"),
        names.music_name(F.col("name"), field["title"], field["track"]).alias("wanted"),
    )


def organize_music(
    manifest: DataFrame,
    output: str,
    tags: str = "tags",
    existing: DataFrame | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    return _settle(music_targets(manifest, tags), output, existing, group_rows)
