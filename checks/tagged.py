"""Photos, videos and music filed by tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import projections as p
from checks.registry import query
from stowage.functions import dates, names
from stowage.operators import tagging
from stowage.plans import common, media
from stowage.sinks import reports
from stowage.sources import tags as tag_source

_STAMP = "strftime(taken, '%Y%m%d_%H%M%S')"
_TREE = "strftime(taken, '%Y/%m-%B')"
_TEXT = "yyyy-MM-dd HH:mm:ss"
_SQL_TEXT = "'%Y-%m-%d %H:%M:%S'"


def _sanitized(text):
    clean = f"left(trim(regexp_replace({text}, '[<>:\"/\\\\|?*]', '_', 'g'), '. '), 200)"
    return f"coalesce(nullif({clean}, ''), 'Unknown')"


@query(
    "exif_first_date",
    f"WITH {p.PHOTOS} SELECT size AS key, strftime(taken, {_SQL_TEXT}) AS taken, make FROM photos "
    "WHERE make IS NOT NULL",
)
def exif_first_date(spark, folder):
    _, tags = p.photos(spark, folder)
    key = F.regexp_extract("path", r"IMG_(\d+)", 1).cast("bigint").alias("key")
    return tagging.photo_facts(tags).select(
        key, F.date_format("taken", _TEXT).alias("taken"), F.btrim("make").alias("make")
    )


_PHOTO_TARGET = f"""CASE WHEN taken IS NOT NULL
    THEN 'out/' || {_TREE} || '/' || {_STAMP} || '_' || stem || suffix
    WHEN make IS NOT NULL THEN 'out/by_make/' || {_sanitized('make')} || '/' || stem || suffix END"""


@query(
    "photo_plan",
    f"""WITH {p.PHOTOS} SELECT 'card/' || stem || suffix AS path, {_PHOTO_TARGET} AS target,
        CASE WHEN taken IS NULL AND make IS NULL THEN 'skip' ELSE 'move' END AS action,
        CASE WHEN taken IS NOT NULL THEN 'date' WHEN make IS NOT NULL THEN 'make'
        ELSE 'no date and no make' END AS reason FROM photos""",
)
def photo_plan(spark, folder):
    manifest, tags = p.photos(spark, folder)
    return media.organize_photos(manifest, tags, "out").select("path", "target", "action", "reason")


@query(
    "photo_outcome",
    f"""WITH {p.PHOTOS} SELECT count(*) AS processed, count(coalesce(make, '' || taken)) AS moved,
        count(*) FILTER (make IS NULL AND taken IS NULL) AS skipped, CAST(0 AS BIGINT) AS errors,
        CAST(0 AS BIGINT) AS skipped_space, CAST(0 AS BIGINT) AS duplicates_skipped,
        CAST(0 AS BIGINT) AS duplicates_removed FROM photos""",
)
def photo_outcome(spark, folder):
    manifest, tags = p.photos(spark, folder)
    targets = media.photo_targets(manifest, tags)
    return common.outcome(common.as_plan(targets, reason=F.col("reason")))


@query(
    "camera_tree",
    f"SELECT p_partkey AS key, 'by_make/' || {_sanitized('p_brand')} AS directory, "
    "'by_make/' || p_brand AS raw FROM part",
)
def camera_tree(spark, folder):
    brand = F.concat(F.lit(" "), "p_brand", F.lit(" "))
    return p.table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"),
        names.make_dir(brand).alias("directory"),
        names.make_dir(brand, raw=True).alias("raw"),
    )


@query(
    "container_date",
    f"""WITH {p.VIDEOS} SELECT size AS key, failed,
        CASE WHEN NOT failed THEN strftime(found, {_SQL_TEXT}) END AS taken FROM videos""",
)
def container_date(spark, folder):
    rows = tag_source.read_probe(p.videos(spark, folder), "probe")
    taken = F.date_format(dates.container_date(F.col("tags")), _TEXT)
    return rows.select(F.col("size").alias("key"), "failed", taken.alias("taken"))


@query(
    "video_plan",
    f"""WITH {p.VIDEOS} SELECT 'cam/' || stem || suffix AS path,
        CASE WHEN failed THEN 'error' ELSE 'move' END AS action,
        CASE WHEN failed THEN 'unreadable tags' WHEN found IS NOT NULL THEN 'date' ELSE 'file time' END AS reason,
        CASE WHEN NOT failed THEN 'out/' || {_TREE} || '/' || {_STAMP} || '_' || stem || suffix END AS target
    FROM videos""",
)
def video_plan(spark, folder):
    plan = media.organize_videos(p.videos(spark, folder), "out")
    return plan.select("path", "action", "reason", "target")


@query(
    "date_tree",
    """SELECT o_orderkey AS key, strftime(o_orderdate, '%Y/%m-%B') AS directory,
        strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || trim(o_orderpriority, '. ') || '.jpg' AS name FROM orders""",
)
def date_tree(spark, folder):
    taken = F.col("o_orderdate")
    return p.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        names.dated_dir(taken).alias("directory"),
        names.dated_name(F.concat("o_orderpriority", F.lit(".jpg")), taken).alias("name"),
    )


@query(
    "date_fallback",
    """SELECT event_id AS key, strftime(ts, '%Y/%m-%B') AS directory,
        strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type || '.mp4' AS name FROM events""",
)
def date_fallback(spark, folder):
    """No tags at all: file time decides."""
    taken = F.coalesce(F.lit(None).cast("timestamp_ntz"), dates.file_date(F.col("ts")))
    return p.table(spark, folder, "events").select(
        F.col("event_id").alias("key"),
        names.dated_dir(taken).alias("directory"),
        names.dated_name(F.concat("event_type", F.lit(".mp4")), taken).alias("name"),
    )


_MUSIC_NAME = f"""{_sanitized("CASE WHEN track IS NULL THEN '' ELSE track || ' - ' END || "
    + _sanitized("coalesce(title, stem)") + " || suffix")}"""


@query(
    "music_tree",
    f"""WITH {p.MUSIC} SELECT size AS key, {_sanitized('artist')} || '/' || {_sanitized('album')} AS directory,
        {_MUSIC_NAME} AS name FROM music""",
)
def music_tree(spark, folder):
    targets = media.music_targets(p.music(spark, folder))
    return targets.select(F.col("size").alias("key"), "directory", F.col("wanted").alias("name"))


@query(
    "music_plan",
    f"""WITH {p.MUSIC}, wanted AS (SELECT size, 'disc/' || stem || suffix AS path,
        'out/' || {_sanitized('artist')} || '/' || {_sanitized('album')} || '/' AS directory,
        {_MUSIC_NAME} AS name FROM music),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY directory, name ORDER BY path) - 1 AS i FROM wanted),
    final AS (SELECT *, left(name, length(name) - 4)
        || CASE WHEN i = 0 THEN '' ELSE '_' || array_to_string(range(1, i + 1), '_') END || '.mp3' AS final_name
        FROM ranked)
    SELECT path, size, CASE WHEN octet_length(encode(final_name)) > 255 THEN 'error' ELSE 'move' END AS action,
        CASE WHEN octet_length(encode(final_name)) <= 255 THEN directory || final_name END AS target
    FROM final""",
)
def music_plan(spark, folder):
    plan = media.organize_music(p.music(spark, folder), "out")
    return plan.select("path", "size", "action", "target")


@query(
    "track_numbers",
    """SELECT p_partkey AS key, lpad(CAST(p_size AS VARCHAR), 2, '0') AS of_total,
        CASE WHEN p_size < 10 THEN '0' || p_size ELSE '' || p_size END AS leading_zeros,
        'A' || p_size AS lettered, NULL::VARCHAR AS blank FROM part""",
)
def track_numbers(spark, folder):
    size = F.col("p_size").cast("string")
    return p.table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"),
        names.track_prefix(F.concat(size, F.lit("/50"))).alias("of_total"),
        names.track_prefix(F.concat(F.lit("000"), size)).alias("leading_zeros"),
        names.track_prefix(F.concat(F.lit("A"), size)).alias("lettered"),
        names.track_prefix(F.concat(F.lit("/"), size)).alias("blank"),
    )


@query(
    "tag_precedence",
    """SELECT p_partkey AS key, CASE WHEN p_partkey % 9 <> 0 THEN p_brand ELSE 'Various: All' END AS artist,
        p_type AS album, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title,
        CASE WHEN p_partkey % 6 <> 0 THEN p_size || '/50' END AS track,
        NULL::VARCHAR AS genre FROM part""",
)
def tag_precedence(spark, folder):
    fields = ["artist", "album", "title", "track", "genre"]
    return p.music(spark, folder).select(
        F.col("size").alias("key"), *[tagging.music_field(F.col("tags"), f).alias(f) for f in fields]
    )


_FILES = "'log/' || event_type || '_' || event_id || '.json'"


@query(
    "tag_dump",
    f"""WITH files AS (SELECT {_FILES} AS path, event_type || '_' || event_id || '.json' AS name,
        json_extract_string(props, '$.k') AS k FROM events)
    SELECT path, name, -2 AS place, '==========' AS line FROM files
    UNION ALL SELECT path, name, -1, name FROM files
    UNION ALL SELECT path, name, 0, CASE WHEN k IS NULL THEN 'No EXIF data found.' ELSE 'k: ' || k END FROM files""",
)
def tag_dump(spark, folder):
    name = F.concat("event_type", F.lit("_"), F.col("event_id").cast("string"), F.lit(".json"))
    files = p.table(spark, folder, "events").select(
        F.concat(F.lit("log/"), name).alias("path"),
        name.alias("name"),
        F.from_json("props", "map<string,string>").alias("tags"),
    )
    return reports.tag_dump(files, tag_source.explode_tags(files, "path", "tags"))
