"""Filters, counts and names over collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks import projections as p
from checks.registry import query
from stowage.functions import names, sizes
from stowage.operators import counting, filters
from stowage.plans.extensions import output_directories
from stowage.sinks import reports
from stowage.sources.tables import from_table

_EXT = r"regexp_extract(name, '(?s)^.+(\.[^.]+)$', 1)"
_LABEL = f"coalesce(nullif(ltrim(lower({_EXT}), '.'), ''), 'no_extension')"


@query("include_globs", f"WITH {p.DOCS} SELECT path FROM docs WHERE name LIKE '%.de' OR name LIKE 'doc1%'")
def include_globs(spark, folder):
    return filters.include_globs(p.docs(spark, folder), ["*.DE", "doc1*"]).select("path")


@query(
    "exclude_globs",
    f"WITH {p.DOCS} SELECT path FROM docs WHERE name NOT LIKE '%.fr' AND NOT regexp_matches(name, '^doc.[0-4]')",
)
def exclude_globs(spark, folder):
    return filters.exclude_globs(p.docs(spark, folder), ["*.fr", "Doc?[0-4]*"]).select("path")


@query(
    "glob_classes",
    f"WITH {p.PAGES} SELECT path FROM pgs WHERE regexp_matches(lower(name), '^[^a-z].*[0-4x]$')",
)
def glob_classes(spark, folder):
    return filters.include_globs(p.pages(spark, folder), ["[!A-Z]*[0-4X]"]).select("path")


@query("hidden_filter", f"WITH {p.DOCS} SELECT path FROM docs WHERE NOT regexp_matches(path, '(^|/)\\.')")
def hidden_filter(spark, folder):
    return filters.visible(p.docs(spark, folder)).select("path")


@query(
    "union_scans",
    f"""WITH {p.DOCS}, {p.PAGES}, both_scans AS (
        SELECT path, size FROM docs UNION ALL SELECT path, size FROM pgs)
    SELECT split_part(path, '/', 1) AS top, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
    FROM both_scans GROUP BY 1""",
)
def union_scans(spark, folder):
    both = p.docs(spark, folder).select("path", "size").unionByName(p.pages(spark, folder).select("path", "size"))
    return both.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )


@query(
    "type_counts",
    f"WITH {p.DOCS} SELECT {_LABEL} AS ext, count(*) AS n FROM docs "
    "WHERE NOT regexp_matches(path, '(^|/)\\.') GROUP BY 1",
)
def type_counts(spark, folder):
    return counting.type_counts(filters.visible(p.docs(spark, folder)))


@query("type_counts_pages", f"WITH {p.PAGES} SELECT {_LABEL} AS ext, count(*) AS n FROM pgs GROUP BY 1")
def type_counts_pages(spark, folder):
    return counting.type_counts(p.pages(spark, folder))


@query(
    "type_share",
    f"""WITH {p.DOCS}, counts AS (SELECT {_LABEL} AS ext, count(*) AS n FROM docs GROUP BY 1)
    SELECT ext, n, CAST(n AS DOUBLE) / sum(n) OVER () * 100 AS share FROM counts""",
)
def type_share(spark, folder):
    return counting.type_share(p.docs(spark, folder))


@query(
    "type_examples",
    f"""WITH {p.DOCS}, ranked AS (SELECT {_LABEL} AS ext, path,
        row_number() OVER (PARTITION BY {_LABEL} ORDER BY path) AS rank,
        count(*) OVER (PARTITION BY {_LABEL}) AS n FROM docs)
    SELECT ext, rank, path, greatest(n - 10, 0) AS more FROM ranked WHERE rank <= 10""",
)
def type_examples(spark, folder):
    return counting.type_examples(p.docs(spark, folder))


@query("type_paths", f"WITH {p.PAGES} SELECT {_LABEL} AS ext, path FROM pgs")
def type_paths(spark, folder):
    return counting.type_paths(p.pages(spark, folder))


@query(
    "type_report",
    f"""WITH {p.DOCS}, ranked AS (SELECT lang AS ext, path,
        row_number() OVER (PARTITION BY lang ORDER BY path) AS rn,
        count(*) OVER (PARTITION BY lang) AS n FROM docs)
    SELECT ext, 1::BIGINT AS examples_from, count(*) AS lines FROM ranked WHERE rn <= 11 GROUP BY 1, 2""",
)
def type_report(spark, folder):
    """Example lines per extension: ten paths and, beyond ten, one line for the rest."""
    report = reports.type_report(p.docs(spark, folder), details=True)
    lines = report.filter("section = 1 and kind in (1, 2)")
    return lines.groupBy("ext").agg(F.count("*").alias("lines")).withColumn(
        "examples_from", F.lit(1).cast("bigint")
    )


@query(
    "suffix_variants",
    f"""WITH {p.PAGES} SELECT path, {_LABEL} AS label,
        coalesce(nullif(lower({_EXT}), ''), 'no_extension') AS dotted, ltrim(lower({_EXT}), '.') AS bare,
        CASE WHEN {_LABEL} = 'no_extension' THEN '(no extension)' ELSE {_LABEL} END AS shown FROM pgs""",
)
def suffix_variants(spark, folder):
    name = F.col("name")
    return p.pages(spark, folder).select(
        "path",
        names.extension_label(name).alias("label"),
        names.suffix_label(name).alias("dotted"),
        names.extension(name).alias("bare"),
        names.display_label(names.extension_label(name)).alias("shown"),
    )


@query(
    "stem_name_parts",
    f"""WITH {p.PAGES} SELECT path, name, left(name, length(name) - length({_EXT})) AS stem,
        {_EXT} AS suffix, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
        length(regexp_replace(path, '[^/]', '', 'g')) + 1 AS depth FROM pgs""",
)
def stem_name_parts(spark, folder):
    return p.pages(spark, folder).select(
        "path",
        "name",
        names.stem_of(F.col("name")).alias("stem"),
        names.suffix_of(F.col("name")).alias("suffix"),
        F.col("dir").alias("parent"),
        F.col("depth").cast("bigint").alias("depth"),
    )


def _sanitized(text):
    clean = f"left(trim(regexp_replace({text}, '[<>:\"/\\\\|?*]', '_', 'g'), '. '), 200)"
    return f"coalesce(nullif({clean}, ''), 'Unknown')"


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "sanitize_names",
    f"""SELECT page_id, {_sanitized('url')} AS url_name, {_sanitized(_TITLE)} AS title_name,
        {_sanitized('html')} AS html_name FROM pages""",
)
def sanitize_names(spark, folder):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.table(spark, folder, "pages").select(
        "page_id",
        names.sanitize(F.col("url")).alias("url_name"),
        names.sanitize(title).alias("title_name"),
        names.sanitize(F.col("html")).alias("html_name"),
    )


@query(
    "human_bytes",
    f"""WITH {p.DOCS}, big AS (SELECT path, size * (doc_id + 1) * (doc_id + 1) * 977 AS size FROM docs)
    SELECT path, CASE WHEN size < 1024 THEN 'B' WHEN size < 1048576 THEN 'KB' WHEN size < 1073741824 THEN 'MB'
        WHEN size < 1099511627776 THEN 'GB' WHEN size < 1125899906842624 THEN 'TB' ELSE 'PB' END AS unit,
        size / CASE WHEN size < 1024 THEN 1.0 WHEN size < 1048576 THEN 1024.0
        WHEN size < 1073741824 THEN 1048576.0 WHEN size < 1099511627776 THEN 1073741824.0
        WHEN size < 1125899906842624 THEN 1099511627776.0 ELSE 1125899906842624.0 END AS value FROM big""",
)
def human_bytes(spark, folder):
    """The product is exact up to 38 digits, where 64 bits would overflow; beyond, it is floating point."""
    number = F.regexp_extract("name", r"\Adoc(-?[0-9]+)\.", 1)
    rows = p.docs(spark, folder).withColumn("next", number.cast("decimal(20,0)") + 1)

    def product(kind):
        factors = [F.col("size"), F.col("next"), F.col("next"), F.lit(977)]
        return reduce(F.try_multiply, [f.cast(kind) for f in factors]).cast("double")

    size = F.coalesce(product("decimal(38,0)"), product("double"))
    return rows.select("path", sizes.human_unit(size).alias("unit"), sizes.human_value(size).alias("value"))


@query(
    "size_units",
    f"WITH {p.DOCS} SELECT path, size / 1073741824.0 AS gb, size / 1048576.0 AS mb, "
    "CAST(size AS DOUBLE) / sum(size) OVER () * 100 AS share FROM docs",
)
def size_units(spark, folder):
    rows = p.docs(spark, folder).select("path", "size")
    total = rows.agg(F.sum("size").alias("total"))
    size = F.col("size")
    return rows.select(
        "path",
        sizes.gigabytes(size).alias("gb"),
        sizes.megabytes(size).alias("mb"),
        sizes.percent(size, total.scalar()).alias("share"),
    )


@query(
    "extension_membership",
    f"WITH {p.DOCS} SELECT path, lang AS ext FROM docs WHERE lang IN ('de', 'fr')",
)
def extension_membership(spark, folder):
    return filters.with_extensions(p.docs(spark, folder), [*p.JUNK, "DE"]).select("path", "ext")


@query(
    "requested_ext_counts",
    f"""WITH {p.DOCS}, wanted(ext) AS (VALUES ('de'), ('fr'), ('xyz'), (''))
    SELECT ext, count(name) AS n FROM wanted LEFT JOIN docs ON lang = ext GROUP BY 1""",
)
def requested_ext_counts(spark, folder):
    return counting.requested_counts(p.docs(spark, folder), ["de", ".FR", "xyz", "."])


@query(
    "requested_directories",
    f"""WITH {p.DOCS}, wanted(ext) AS (VALUES ('de'), ('fr'), ('xyz'))
    SELECT 'out/' || ext || '_files' AS directory, count(name) AS files
    FROM wanted LEFT JOIN docs ON lang = ext GROUP BY 1""",
)
def requested_directories(spark, folder):
    rows = p.docs(spark, folder)
    extensions = ["de", "fr", "xyz"]
    files = filters.with_extensions(rows, extensions).select(
        names.under("out", names.extension_dir(F.col("ext"))).alias("directory"), "path"
    )
    listed = output_directories(rows, extensions, "out").join(files, "directory", "left")
    return listed.groupBy("directory").agg(F.count("path").alias("files"))


@query("flat_scan", f"WITH {p.DOCS} SELECT name AS path, size FROM docs WHERE lang = 'en'")
def flat_scan(spark, folder):
    """English documents lie in the root, all others one level down."""
    rel = F.when(F.col("lang") == "en", F.col("name")).otherwise(F.concat("lang", F.lit("/"), "name"))
    rows = from_table(p.docs(spark, folder), rel, size=F.col("size"))
    return filters.at_depth(rows, 1).select("path", "size")


@query("non_empty_by_size", f"WITH {p.FLAT} SELECT path, size FROM flat WHERE size > 0")
def non_empty_by_size(spark, folder):
    rows = filters.non_empty(filters.at_depth(p.flat_docs(spark, folder), 1))
    return rows.select("path", "size").orderBy(F.desc("size"), "path")


_MEDIA_NAMES = """named AS (
  SELECT o_orderkey AS key, 'f' || o_orderkey || '.' || CASE o_orderkey % 6 WHEN 0 THEN 'JPG' WHEN 1 THEN 'cr2'
    WHEN 2 THEN 'Mkv' WHEN 3 THEN 'm2ts' WHEN 4 THEN 'FLAC' ELSE 'txt' END AS name FROM orders)"""


@query(
    "media_families",
    f"""WITH {_MEDIA_NAMES} SELECT name, CASE WHEN key % 6 < 2 THEN 'photo' WHEN key % 6 < 4 THEN 'video'
        ELSE 'music' END AS family FROM named WHERE key % 6 < 5""",
)
def media_families(spark, folder):
    key = F.col("o_orderkey")
    suffix = F.element_at(F.array(*map(F.lit, ["JPG", "cr2", "Mkv", "m2ts", "FLAC", "txt"])), (key % 6 + 1).cast("int"))
    rows = p.table(spark, folder, "orders").select(F.concat(F.lit("f"), key.cast("string"), F.lit("."), suffix).alias("name"))
    found = [filters.media(rows, f).withColumn("family", F.lit(f)) for f in ("photo", "video", "music")]
    return found[0].unionByName(found[1]).unionByName(found[2])
