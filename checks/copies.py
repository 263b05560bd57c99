"""Exact copies among documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import projections as p
from checks.registry import query
from stowage.functions import names, sizes
from stowage.operators import duplicates
from stowage.operators.scratch import new_folder, save
from stowage.plans import common
from stowage.plans.dedupe import dedupe, dedupe_contents
from stowage.sinks import digests as digest_sink
from stowage.sinks import reports
from stowage.sources import digests


@query(
    "dedupe_plan",
    f"""WITH {p.HASHED},
    ranked AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n,
        first_value(path) OVER (PARTITION BY hash ORDER BY length(path), path) AS kept FROM hashed)
    SELECT path, CASE WHEN path = kept THEN 'keep' ELSE 'remove' END AS action,
        CASE WHEN path <> kept THEN 'copy of ' || kept END AS reason, size, hash AS group_key
    FROM ranked""",
)
def dedupe_plan(spark, folder):
    plan = dedupe_contents(p.docs(spark, folder, content=True), "text")
    return plan.select("path", "action", "reason", "size", "group_key")


@query(
    "dedupe_sets",
    f"""WITH {p.HASHED}
    SELECT hash, count(*) AS n, arg_min(path, (length(path), path)) AS keep_path,
        CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) - min(size) AS BIGINT) AS freed_bytes
    FROM hashed GROUP BY hash HAVING count(*) > 1""",
)
def dedupe_sets(spark, folder):
    return duplicates.duplicate_sets(p.hashed_docs(spark, folder))


@query(
    "dedupe_totals",
    f"""WITH {p.HASHED}, sets AS (
        SELECT hash, count(*) AS n, sum(size) AS bytes, min(size) AS one FROM hashed GROUP BY hash)
    SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS unique_hashes,
        count(*) FILTER (n > 1) AS duplicate_sets, CAST(sum(n - 1) AS BIGINT) AS to_remove,
        CAST(sum(bytes - one) AS BIGINT) AS freed_bytes FROM sets""",
)
def dedupe_totals(spark, folder):
    return duplicates.totals(p.hashed_docs(spark, folder))


_KEEP_ORDER = {
    "shortest_path": "length(path), path",
    "oldest": "mtime, path",
    "newest": "mtime DESC, path",
    "largest_name": "length(name) DESC, path",
    "first_alphabetical": "lower(path), path",
}


def _keep_query(strategy, order):
    @query(
        f"dedupe_keep_{strategy}",
        f"""WITH {p.HASHED}, ranked AS (
            SELECT path, hash, size, row_number() OVER (PARTITION BY hash ORDER BY {order}) AS rn FROM hashed)
        SELECT path, CASE WHEN rn = 1 THEN 'keep' ELSE 'remove' END AS action, size, hash AS group_key
        FROM ranked""",
    )
    def run(spark, folder):
        plan = dedupe(p.hashed_docs(spark, folder), strategy)
        return plan.select("path", "action", "size", "group_key")


for _strategy, _order in _KEEP_ORDER.items():
    _keep_query(_strategy, _order)


@query(
    "dedupe_space_saved",
    f"""WITH {p.HASHED}, ranked AS (
        SELECT size, row_number() OVER (PARTITION BY hash ORDER BY length(path), path) AS rn FROM hashed)
    SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS freed_bytes,
        coalesce(sum(size), 0) / 1073741824.0 AS freed_gb FROM ranked WHERE rn > 1""",
)
def dedupe_space_saved(spark, folder):
    sets = duplicates.duplicate_sets(p.hashed_docs(spark, folder))
    freed = F.coalesce(F.sum("freed_bytes"), F.lit(0))
    return sets.agg(freed.alias("freed_bytes"), sizes.gigabytes(freed).alias("freed_gb"))


def _algorithm_query(algorithm):
    @query(
        f"dedupe_{algorithm}",
        f"""WITH {p.DOCS}
        SELECT {algorithm}(text) AS hash, count(*) AS n, min(path) AS first_path FROM docs GROUP BY 1""",
    )
    def run(spark, folder):
        rows = p.hashed_docs(spark, folder, algorithm)
        return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


for _algorithm in ("md5", "sha1"):
    _algorithm_query(_algorithm)


@query(
    "digest_table",
    f"""WITH {p.DOCS}
    SELECT path, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1,
        substr(sha256(text), 1, 16) AS prefix FROM docs""",
)
def digest_table(spark, folder):
    rows = p.docs(spark, folder, content=True).select(
        "path", *[digests.digest(F.col("text"), a).alias(a) for a in digests.ALGORITHMS]
    )
    return rows.withColumn("prefix", names.hash_prefix(F.col("sha256")))


@query(
    "dedupe_report",
    f"""WITH {p.HASHED}, counted AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM hashed)
    SELECT dense_rank() OVER (ORDER BY hash) AS set_no, hash, n, path, size / 1048576.0 AS megabytes
    FROM counted WHERE n > 1""",
)
def dedupe_report(spark, folder):
    return reports.set_listing(p.hashed_docs(spark, folder))


@query(
    "paths_by_hash",
    f"WITH {p.HASHED} SELECT hash, path, count(*) OVER (PARTITION BY hash) AS n FROM hashed "
    "QUALIFY n > 1",
)
def paths_by_hash(spark, folder):
    return duplicates.set_members(p.hashed_docs(spark, folder)).select("hash", "path", "n")


@query(
    "same_size_files",
    f"WITH {p.DOCS} SELECT path, size FROM docs QUALIFY count(*) OVER (PARTITION BY size) > 1",
)
def same_size_files(spark, folder):
    rows = save(p.docs(spark, folder).select("path", "size"))
    return digests.same_size_only(rows)


# -- incoming files against what is in place ----------------------------------------------

_IN_PLACE = "(" + ", ".join(f"'{s}'" for s in p.IN_PLACE) + ")"
_KEYS = {"size": "size", "hash": "hash", "both": "size, hash"}


def _incoming(spark, folder, method, remove=False):
    rows = p.hashed_docs(spark, folder).withColumn("directory", names.extension_dir(F.col("lang")))
    held = F.col("source").isin(p.IN_PLACE)
    return duplicates.mark_incoming(
        rows.filter(~held), rows.filter(held), "directory", method, remove=remove
    )


def _incoming_sql(method, copy="skip"):
    keys = _KEYS[method]
    same = " AND ".join(f"e.{k} = i.{k}" for k in ["lang", *keys.split(", ")])
    return f"""WITH {p.HASHED},
    held AS (SELECT * FROM hashed WHERE source IN {_IN_PLACE}),
    incoming AS (SELECT *, row_number() OVER (PARTITION BY lang, {keys} ORDER BY path) AS rn
        FROM hashed WHERE source NOT IN {_IN_PLACE}),
    marked AS (SELECT path, size, lang, CASE WHEN rn > 1 OR EXISTS
        (SELECT 1 FROM held e WHERE {same}) THEN '{copy}' ELSE 'move' END AS action FROM incoming i)"""


def _skip_query(method):
    @query(f"skip_dups_{method}", _incoming_sql(method) + " SELECT path, size, action FROM marked")
    def run(spark, folder):
        return _incoming(spark, folder, method).select("path", "size", "action")


for _method in duplicates.MATCH_METHODS:
    _skip_query(_method)


@query(
    "remove_source_dups",
    _incoming_sql("hash", "remove") + " SELECT path, size, action FROM marked WHERE action = 'remove'",
)
def remove_source_dups(spark, folder):
    return _incoming(spark, folder, "hash", remove=True).filter("action = 'remove'").select(
        "path", "size", "action"
    )


@query(
    "outcome_summary",
    _incoming_sql("hash", "remove")
    + """ SELECT count(*) AS processed, count(*) FILTER (action = 'move') AS moved,
        CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS skipped_space,
        count(*) FILTER (action = 'remove') AS duplicates_skipped,
        count(*) FILTER (action = 'remove') AS duplicates_removed FROM marked""",
)
def outcome_summary(spark, folder):
    return common.outcome(_incoming(spark, folder, "hash", remove=True))


@query(
    "outcome_by_type",
    _incoming_sql("size") + " SELECT lang AS group_key, action, count(*) AS files FROM marked GROUP BY ALL",
)
def outcome_by_type(spark, folder):
    marked = _incoming(spark, folder, "size")
    return common.outcome_by_group(common.as_plan(marked, group_key=F.col("lang")))


@query(
    "new_vs_hashdb",
    f"""WITH {p.HASHED}
    SELECT path, hash, hash IN (SELECT hash FROM hashed WHERE source IN {_IN_PLACE}) AS known
    FROM hashed WHERE source NOT IN {_IN_PLACE}""",
)
def new_vs_hashdb(spark, folder):
    rows = p.hashed_docs(spark, folder)
    held = F.col("source").isin(p.IN_PLACE)
    database = new_folder(spark, "database")
    digest_sink.save_digests(rows.filter(held), database, "sha256", "2024-01-01 00:00:00")
    flagged = duplicates.against_digests(rows.filter(~held), digests.load_digests(spark, database))
    return flagged.select("path", "hash", "known")


@query("hashdb_roundtrip", f"WITH {p.HASHED} SELECT hash, path, 'sha256' AS algorithm FROM hashed")
def hashdb_roundtrip(spark, folder):
    database = new_folder(spark, "database")
    digest_sink.save_digests(p.hashed_docs(spark, folder), database, "sha256", "2024-01-01 00:00:00")
    return digests.load_digests(spark, database).select("hash", "path", "algorithm")


@query("hashdb_json_roundtrip", f"WITH {p.HASHED} SELECT hash, path FROM hashed")
def hashdb_json_roundtrip(spark, folder):
    database = new_folder(spark, "json")
    digest_sink.save_digests_json(p.hashed_docs(spark, folder), database, "sha256", "2024-01-01 00:00:00")
    rows, _ = digests.load_digests_json(spark, database)
    return rows
