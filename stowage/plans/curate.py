"""The whole tidy-up in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import names, sizes
from stowage.operators import collisions, counting, duplicates, filters, packing
from stowage.operators.scratch import save
from stowage.plans.common import as_plan
from stowage.plans.media import music_targets, photo_targets, video_targets
from stowage.schema import MEDIA_FAMILIES, NAME_BYTES

_CLAIM = ["path", "size", "action", "reason", "directory", "wanted"]


def profile(hashed: DataFrame) -> DataFrame:
    """(ext, n, share): what the collection consists of, before anything is moved."""
    return counting.type_share(hashed)


def curate(
    hashed: DataFrame,
    output: str,
    junk: list[str],
    junk_output: str,
    photo_tags: DataFrame | None = None,
    strategy: str = "shortest_path",
    group_rows: int | None = None,
    max_size_gb: float | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Drop copies, move junk aside, file what is left by family, split the rest; one row per file.

    ``hashed`` is a manifest with hash and, if known, probe and tags columns.  Copies are never moved, junk is
    not filed.  With ``max_size_gb``, non-empty files that no step has moved go to batches below that size, else they
    stay ('keep').  All claims on names are settled together, so no two files get one target, whatever
    their families and also if ``junk_output`` lies in ``output``.  ``existing`` (directory, name) are
    whole target directories and the names in them.
    """
    rows = save(duplicates.mark_duplicates(hashed, strategy, group_rows), "marked")
    kept = rows.filter("action = 'keep'").drop("action", "n", "keep_path")
    wanted = names.normalize_extensions(junk)
    is_junk = F.coalesce(names.extension(F.col("name")).isin(wanted), F.lit(False))
    left = kept.filter(~is_junk)

    tags = photo_tags
    if tags is None:
        tags = rows.sparkSession.createDataFrame([], "path string, pos int, tag string, value string")
    filed = photo_targets(left, tags).select(*_CLAIM)
    families = ["photo"]
    if "probe" in left.columns:
        filed, families = filed.unionByName(video_targets(left).select(*_CLAIM)), [*families, "video"]
    if "tags" in left.columns:
        filed, families = filed.unionByName(music_targets(left).select(*_CLAIM)), [*families, "music"]
    suffixes = [s for family in families for s in MEDIA_FAMILIES[family]]
    rest = left.filter(~F.coalesce(names.suffix_label(F.col("name")).isin(suffixes), F.lit(False)))

    aside = kept.filter(is_junk).select(
        "path",
        "size",
        F.lit("move").alias("action"),
        F.lit(None).cast("string").alias("reason"),
        names.extension_dir(names.extension(F.col("name"))).alias("directory"),
        F.col("name").alias("wanted"),
    )
    gone = rows.filter("action <> 'keep'")
    reason = F.when(F.col("action") == "remove", F.concat(F.lit("copy of "), "keep_path"))
    gone = gone.select("path", "size", "action", reason.otherwise("unreadable").alias("reason"))
    parts = [
        _placed(aside, junk_output, "plain"),
        _placed(filed, output, "chained"),
        _placed(gone, output, "plain"),
    ]
    if max_size_gb is not None:
        whole = packing.pack(rest.select("path", "name", "size"), sizes.limit_bytes(max_size_gb), group_rows=group_rows)
        whole = whole.select(
            "path",
            "size",
            F.lit("move").alias("action"),
            F.lit(None).cast("string").alias("reason"),
            names.batch_dir(F.col("batch")).alias("directory"),
            F.col("name").alias("wanted"),
        )
        parts.append(_placed(whole, output, "padded"))
        rest = rest.filter("size is null or size <= 0")
    still = rest.select("path", "size", F.lit("keep").alias("action"))
    parts.append(_placed(still, output, "plain"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    every = save(every, "claims")

    if existing is not None:
        held = every.filter("action = 'move'").groupBy("directory").agg(F.max("style").alias("style"))
        existing = existing.select("directory", F.col("name").alias("wanted")).join(held, "directory")
    settled = collisions.resolve(
        every.filter("action = 'move'"),
        "directory",
        "wanted",
        ["bigger", "path"],
        F.col("style"),
        existing,
        group_rows=group_rows,
        longest=NAME_BYTES,
    )
    fits = F.col("final_name").isNotNull()
    done = as_plan(
        settled.withColumn("action", F.when(fits, "move").otherwise("error")),
        F.when(fits, F.concat_ws("/", "directory", "final_name")),
        F.when(fits, F.col("reason")).otherwise("name too long"),
        F.when(fits, F.col("group_key")),
    )
    return done.unionByName(as_plan(every.filter("action <> 'move'"), reason=F.col("reason")))


def _placed(rows: DataFrame, root: str, style: str) -> DataFrame:
    """Claims with the whole target directory, their style and their order (batches: largest first)."""
    order: Column = -F.col("size") if style == "padded" else F.lit(0)
    if "directory" in rows.columns:
        rows = rows.withColumn("group_key", F.col("directory"))
        rows = rows.withColumn("directory", names.under(root, F.col("directory")))
    return rows.select("*", F.lit(style).alias("style"), order.cast("long").alias("bigger"))
