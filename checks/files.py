"""Work on real files: every document is first written to a file by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import projections as p
from checks.registry import query
from stowage.operators.scratch import new_folder
from stowage.operators import filters
from stowage.plans.dedupe import dedupe_files
from stowage.plans.extensions import organize_by_extension
from stowage.sinks import apply, digests as digest_sink
from stowage.sources import digests, tree


def _exported(spark, folder):
    return p.export_files(p.docs(spark, folder, content=True), "tree")


@query("scan_tree", f"WITH {p.DOCS} SELECT path AS rel_path, dir, name, size, CAST(2 AS INTEGER) AS depth FROM docs")
def scan_tree(spark, folder):
    return tree.scan_files(spark, _exported(spark, folder)).select("rel_path", "dir", "name", "size", "depth")


@query(
    "scan_visible",
    f"WITH {p.DOCS} SELECT path AS rel_path, size FROM docs WHERE dir NOT LIKE '.%'",
)
def scan_visible(spark, folder):
    return tree.scan_countable(spark, _exported(spark, folder)).select("rel_path", "size")


@query("scan_directories", f"WITH {p.DOCS} SELECT dir AS rel_path, 1 AS depth FROM docs GROUP BY 1")
def scan_directories(spark, folder):
    """One level only, so files further down do not show."""
    entries = tree.scan_entries(spark, _exported(spark, folder), recursive=False)
    return tree.directories(entries).select("rel_path", "depth")


@query("one_level_down", f"WITH {p.DOCS} SELECT path AS rel_path, size FROM docs")
def one_level_down(spark, folder):
    return filters.at_depth(tree.scan_files(spark, _exported(spark, folder)), 2).select("rel_path", "size")


@query("hash_files", f"WITH {p.HASHED} SELECT path AS rel_path, size, hash FROM hashed")
def hash_files(spark, folder):
    found = tree.scan_files(spark, _exported(spark, folder))
    return digests.hash_files(found).select("rel_path", "size", "hash")


@query(
    "hash_files_md5",
    f"WITH {p.DOCS} SELECT path AS rel_path, md5(text) AS hash FROM docs",
)
def hash_files_md5(spark, folder):
    found = tree.scan_files(spark, _exported(spark, folder))
    database = new_folder(spark, "database")
    hashed = digests.hash_files(found.select("path", "rel_path", "size"), "md5")
    digest_sink.save_digests(hashed.withColumn("path", F.col("rel_path")), database, "md5", "2024-01-01 00:00:00")
    return digests.load_digests(spark, database).select(F.col("path").alias("rel_path"), "hash")


@query(
    "apply_dedupe",
    f"""WITH {p.HASHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY length(path), path) AS rn
        FROM hashed) SELECT path AS rel_path, size FROM ranked WHERE rn = 1""",
)
def apply_dedupe(spark, folder):
    """What is left on disk once the plan has run."""
    root = _exported(spark, folder)
    apply.apply_plan(dedupe_files(tree.scan_files(spark, root)))
    return tree.scan_files(spark, root).select("rel_path", "size")


@query(
    "apply_moves",
    f"""WITH {p.DOCS} SELECT CASE WHEN lang IN ('de', 'fr') THEN 'sorted/' || lang || '_files/' || name
        ELSE path END AS rel_path, size FROM docs""",
)
def apply_moves(spark, folder):
    root = _exported(spark, folder)
    plan = organize_by_extension(tree.scan_files(spark, root), p.JUNK, f"{root}/sorted")
    apply.apply_plan(plan)
    return tree.scan_files(spark, root).select("rel_path", "size")
