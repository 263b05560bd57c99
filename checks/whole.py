"""The whole tidy-up over one collection of documents, photos, videos and songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import projections as p
from checks.arranging import _next_fit
from checks.registry import query
from checks.tagged import _MUSIC_NAME, _PHOTO_TARGET, _STAMP, _TREE, _sanitized
from stowage.operators import counting
from stowage.plans import common
from stowage.plans.curate import curate, profile
from stowage.plans.dedupe import dedupe
from stowage.plans.extensions import organize_by_extension
from stowage.operators.scratch import new_folder
from stowage.sinks import digests as digest_sink
from stowage.sinks import reports
from stowage.sources import digests

_GB = 0.0005
_LIMIT = int(_GB * 1024**3)

#: Photos, videos and songs whose key is divisible by this are copies of each other.
_SAME = {"photo": 97, "video": 89, "song": 83}


def _media_hash(kind):
    key = F.col("size")
    own = F.when(key % _SAME[kind] == 0, "same").otherwise(key.cast("string"))
    return F.sha2(F.concat(F.lit(f"{kind}-"), own), 256)


def _media_sql(kind, table, extra):
    return f"""SELECT path, size, sha256('{kind}-' || CASE WHEN size % {_SAME[kind]} = 0 THEN 'same'
        ELSE CAST(size AS VARCHAR) END) AS hash, '{kind}' AS family, {extra} FROM {table}"""


def collection(spark, folder):
    """(manifest, photo tags): all families in one manifest with digests."""
    photos, tags = p.photos(spark, folder)
    documents = p.hashed_docs(spark, folder)
    parts = [
        documents.select("path", "name", "size", "mtime", "hash"),
        photos.select("path", "name", "size", "mtime", _media_hash("photo").alias("hash")),
        p.videos(spark, folder).select("path", "name", "size", "mtime", "probe", _media_hash("video").alias("hash")),
        p.music(spark, folder).select("path", "name", "size", "mtime", "tags", _media_hash("song").alias("hash")),
    ]
    every = parts[2]
    for part in (parts[0], parts[1], parts[3]):
        every = every.unionByName(part, allowMissingColumns=True)
    return every, tags


_COLLECTION = f"""{p.HASHED}, {p.PHOTOS}, {p.VIDEOS}, {p.MUSIC},
    photo_files AS (SELECT 'card/' || stem || suffix AS path, size, {_PHOTO_TARGET} AS target,
        CASE WHEN taken IS NULL AND make IS NULL THEN 'skip' ELSE 'move' END AS action FROM photos),
    video_files AS (SELECT 'cam/' || stem || suffix AS path, size, CASE WHEN failed THEN 'error' ELSE 'move' END AS action,
        CASE WHEN NOT failed THEN 'out/' || {_TREE} || '/' || {_STAMP} || '_' || stem || suffix END AS target FROM videos),
    song_files AS (SELECT 'disc/' || stem || suffix AS path, size,
        'out/' || {_sanitized('artist')} || '/' || {_sanitized('album')} || '/' AS directory, {_MUSIC_NAME} AS name
        FROM music),
    files AS (
        SELECT path, size, hash, CASE WHEN lang IN ('de', 'fr') THEN 'junk' ELSE 'other' END AS family,
            CASE WHEN lang IN ('de', 'fr') THEN 'move' ELSE 'keep' END AS action,
            CASE WHEN lang IN ('de', 'fr') THEN 'junk/' || lang || '_files/' || name END AS target, name FROM hashed
        UNION ALL {_media_sql("photo", "photo_files", "action, target, NULL AS name")}
        UNION ALL {_media_sql("video", "video_files", "action, target, NULL AS name")}
        UNION ALL {_media_sql("song", "song_files", "'move' AS action, directory AS target, name")}),
    marked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY length(path), path) > 1 AS copy FROM files),
    songs AS (SELECT *, row_number() OVER (PARTITION BY target, name ORDER BY path) - 1 AS i
        FROM marked WHERE family = 'song' AND NOT copy),
    others AS (SELECT path, size, name FROM marked WHERE family = 'other' AND NOT copy)"""


@query(
    "curate_whole",
    f"""WITH RECURSIVE {_COLLECTION}, {_next_fit("others", _LIMIT)},
    final AS (
        SELECT path, size, 'remove' AS action, NULL AS target FROM marked WHERE copy
        UNION ALL SELECT path, size, action, target FROM marked WHERE NOT copy AND family IN ('junk', 'photo', 'video')
        UNION ALL SELECT path, size, 'move', target || left(name, length(name) - 4)
            || CASE WHEN i = 0 THEN '' ELSE '_' || array_to_string(range(1, i + 1), '_') END || '.mp3' FROM songs
        UNION ALL SELECT o.path, o.size, 'move', 'out/batch_' || lpad(CAST(batch AS VARCHAR), 3, '0') || '/' || name
            FROM others o JOIN packed k ON k.path = o.path
        UNION ALL SELECT path, size, 'keep', NULL FROM others WHERE NOT size > 0)
    SELECT path, size, CASE WHEN octet_length(encode(regexp_extract(target, '[^/]*$'))) > 255 THEN 'error' ELSE action END
        AS action, CASE WHEN octet_length(encode(regexp_extract(target, '[^/]*$'))) <= 255 THEN target END AS target
    FROM final""",
)
def curate_whole(spark, folder):
    """Copies, junk, photos, videos, songs, and batches of the rest, in one plan."""
    files, tags = collection(spark, folder)
    plan = curate(files, "out", p.JUNK, "junk", tags, max_size_gb=_GB)
    return plan.select("path", "size", "action", "target")


@query(
    "curate_profile",
    f"""WITH {_COLLECTION}, named AS (SELECT regexp_extract(lower(path), '[^.]*$') AS ext FROM files)
    SELECT ext, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM named) * 100 AS share
    FROM named GROUP BY ext""",
)
def curate_profile(spark, folder):
    return profile(collection(spark, folder)[0])


@query(
    "collection_statistics",
    f"""WITH RECURSIVE {p.FLAT}, {_next_fit('flat', 1_048_576)}, facts AS (
        SELECT count(*) AS n, sum(size) / 1073741824.0 AS size_gb, CAST(max(batch) AS BIGINT) AS estimated_subdirs
        FROM packed)
    SELECT '.' || lang AS ext, count(*) AS n, sum(size) / 1073741824.0 AS size_gb, 0::BIGINT AS estimated_subdirs
    FROM flat WHERE size > 0 GROUP BY lang UNION ALL SELECT NULL, n, size_gb, estimated_subdirs FROM facts""",
)
def collection_statistics(spark, folder):
    found = counting.collection_statistics(p.flat_docs(spark, folder), 1_048_576)
    return found.withColumn("estimated_subdirs", F.coalesce("estimated_subdirs", F.lit(0)))


# -- counters ------------------------------------------------------------------------------

_WANTED = ["de", "FR", "xyz"]


def _organized(spark, folder):
    return organize_by_extension(p.docs(spark, folder), _WANTED, "out", skip_duplicates=True, method="size")


_ORGANIZED = f"""{p.DOCS}, marked AS (SELECT lang, CASE WHEN row_number() OVER (PARTITION BY lang, size ORDER BY path) > 1
    THEN 'skip' ELSE 'move' END AS action FROM docs WHERE lang IN ('de', 'fr'))"""


@query(
    "outcome_by_extension",
    f"""WITH {_ORGANIZED} SELECT ext, count(lang) AS processed, count(*) FILTER (action = 'move') AS moved,
        count(*) FILTER (action = 'skip') AS skipped, 0::BIGINT AS errors, 0::BIGINT AS skipped_space,
        count(*) FILTER (action = 'skip') AS duplicates_skipped, 0::BIGINT AS duplicates_removed
    FROM (VALUES ('de'), ('fr'), ('xyz')) w(ext) LEFT JOIN marked ON lang = ext GROUP BY ext""",
)
def outcome_by_extension(spark, folder):
    """Counted in the job that writes the plan; an extension without a file has zeros."""
    _, found = common.write_counted(_organized(spark, folder), new_folder(spark, "plan"), _WANTED)
    rows = [(ext, *(counts[c] for c in common.COUNTERS)) for ext, counts in found.items()]
    return spark.createDataFrame(rows, "ext string, " + ", ".join(f"{c} long" for c in common.COUNTERS))


@query(
    "outcome_by_extension_of_plan",
    f"""WITH {_ORGANIZED} SELECT ext, count(lang) AS processed, count(*) FILTER (action = 'move') AS moved,
        count(*) FILTER (action = 'skip') AS skipped FROM (VALUES ('de'), ('fr'), ('xyz')) w(ext)
    LEFT JOIN marked ON lang = ext GROUP BY ext""",
)
def outcome_by_extension_of_plan(spark, folder):
    found = common.outcome_by_extension(_organized(spark, folder), _WANTED)
    return found.select("ext", "processed", "moved", "skipped")


@query(
    "run_summary",
    f"""WITH {_ORGANIZED}, c AS (SELECT count(*) AS n, count(*) FILTER (action = 'move') AS m,
        count(*) FILTER (action = 'skip') AS s FROM marked)
    SELECT unnest(['Total files processed: ' || n, 'Files moved: ' || m, 'Files skipped: ' || s, 'Errors: 0',
        'Skipped for lack of space: 0', 'Duplicates skipped: ' || s, 'Duplicates removed from source: 0']) AS line,
        unnest(range(1, 8)) AS place FROM c""",
)
def run_summary(spark, folder):
    counts, _ = common.write_counted(_organized(spark, folder), new_folder(spark, "plan"))
    lines = reports.summary_lines(counts)
    return spark.createDataFrame([(line, i + 1) for i, line in enumerate(lines)], "line string, place long")


@query(
    "dedupe_unreadable",
    f"""WITH {p.HASHED}, known AS (SELECT path, CASE WHEN doc_id % 13 <> 0 THEN hash END AS hash FROM hashed)
    SELECT path, CASE WHEN hash IS NULL THEN 'error' WHEN row_number() OVER (PARTITION BY hash ORDER BY length(path), path) > 1
        THEN 'remove' ELSE 'keep' END AS action FROM known""",
)
def dedupe_unreadable(spark, folder):
    """Files that could not be read match nothing, not even each other."""
    rows = p.hashed_docs(spark, folder)
    number = F.regexp_extract("name", r"doc([0-9]+)", 1).cast("long")
    return dedupe(rows.withColumn("hash", F.when(number % 13 != 0, F.col("hash")))).select("path", "action")


@query(
    "dedupe_hot_sets",
    f"""WITH {p.DOCS}, coarse AS (SELECT path, sha256(lang) AS hash FROM docs)
    SELECT path, CASE WHEN row_number() OVER (PARTITION BY hash ORDER BY length(path), path) > 1 THEN 'remove' ELSE 'keep' END
        AS action FROM coarse""",
)
def dedupe_hot_sets(spark, folder):
    """A few sets hold all files, and are joined in parts of about ten rows."""
    rows = p.hashed_docs(spark, folder).withColumn("hash", F.sha2("lang", 256))
    return dedupe(rows, group_rows=10).select("path", "action")


# -- digests ---------------------------------------------------------------------------------


@query("hashdb_json_one_line", f"WITH {p.HASHED} SELECT hash, path, 'sha256' AS algorithm FROM hashed")
def hashdb_json_one_line(spark, folder):
    """A document without a line break is read by as many tasks as it has blocks."""
    database = new_folder(spark, "json")
    rows = p.hashed_docs(spark, folder)
    digest_sink.save_digests_json(rows, database, "sha256", "2024-01-01 00:00:00", line_end=" ")
    found, metadata = digests.load_digests_json(spark, database)
    return found.withColumn("algorithm", F.lit(metadata["algorithm"]))


@query(
    "approximate_unique",
    f"WITH {p.HASHED} SELECT count(*) AS files, count(DISTINCT hash) AS unique_hashes, true AS within FROM hashed",
)
def approximate_unique(spark, folder):
    """Sketches of two scans, kept beside their digest tables and merged, against the exact number."""
    rows = p.hashed_docs(spark, folder)
    held = F.col("source").isin(p.IN_PLACE)
    folders = [new_folder(spark, "scan") for _ in range(2)]
    for folder_, part in zip(folders, (rows.filter(held), rows.filter(~held))):
        digest_sink.save_digests(part, folder_, "sha256", "2024-01-01 00:00:00", sketch=True)
    found = digests.approximate_unique(digests.load_sketches(spark, *folders))
    exact = rows.agg(F.countDistinct("hash").alias("exact"))
    both = found.unionByName(exact, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in ("files", "unique_hashes", "exact")])
    error = F.abs(F.col("unique_hashes") - F.col("exact"))
    within = error <= F.col("exact") * digest_sink.RELATIVE_ERROR
    return both.select("files", F.col("exact").alias("unique_hashes"), within.alias("within"))


@query(
    "type_report_lines",
    f"""WITH {p.DOCS}, ranked AS (SELECT lang AS ext, path,
        row_number() OVER (PARTITION BY lang ORDER BY path) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM docs),
    total AS (SELECT count(*) AS t FROM docs)
    SELECT '' AS ext, 0::BIGINT AS place, 'File Type Count Summary (Total: ' || t || ' files)' AS line FROM total
    UNION ALL SELECT DISTINCT ext, 0::BIGINT, rpad(ext, 15, ' ') || printf(' : %6d files (%5.1f%%)', n, CAST(n AS DOUBLE) / t * 100)
        FROM ranked, total
    UNION ALL SELECT ext, rn, '    └── ' || path FROM ranked WHERE rn <= 10
    UNION ALL SELECT DISTINCT ext, 0::BIGINT, '    └── ... and ' || (n - 10) || ' more' FROM ranked WHERE n > 10""",
)
def type_report_lines(spark, folder):
    """The lines of the report themselves, but for rules and blank ones."""
    report = reports.type_report(p.docs(spark, folder), details=True)
    return report.filter("line rlike '[a-z]'").select("ext", "place", "line")
