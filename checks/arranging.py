"""Batches, names without collisions, and moves by extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import projections as p
from checks.registry import query
from stowage.functions import names
from stowage.operators import batching, collisions, counting, emptiness, filters, packing
from stowage.plans.curate import curate as curate_plan
from stowage.plans.extensions import organize_by_extension
from stowage.plans.split import flatten_batches as flatten
from stowage.plans.split import split_into_batches

LIMIT = 20_000


def _next_fit(source, limit, key="''"):
    """Next-fit as a recursive walk over files in descending size, per key."""
    return f"""ordered AS (SELECT {key} AS grp, path, size,
        row_number() OVER (PARTITION BY {key} ORDER BY size DESC, path) AS rn FROM {source} WHERE size > 0),
    packed AS (
      SELECT grp, rn, path, size, CAST(1 AS BIGINT) AS batch, size AS used FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.grp, o.rn, o.path, o.size,
        CASE WHEN w.used + o.size > {limit} THEN w.batch + 1 ELSE w.batch END,
        CASE WHEN w.used + o.size > {limit} THEN o.size ELSE w.used + o.size END
      FROM packed w JOIN ordered o ON o.grp = w.grp AND o.rn = w.rn + 1)"""


@query(
    "pack_batches",
    f"WITH RECURSIVE {p.FLAT}, {_next_fit('flat', LIMIT)} SELECT path, size, batch FROM packed",
)
def pack_batches(spark, folder):
    return packing.pack(p.flat_docs(spark, folder).select("path", "size"), LIMIT)


@query(
    "pack_small_limit",
    f"WITH RECURSIVE {p.FLAT}, {_next_fit('flat', 3000)} SELECT path, size, batch FROM packed",
)
def pack_small_limit(spark, folder):
    """Most files exceed this limit and stand alone."""
    return packing.pack(p.flat_docs(spark, folder).select("path", "size"), 3000)


@query(
    "pack_totals",
    f"""WITH RECURSIVE {p.FLAT}, {_next_fit('flat', LIMIT)}
    SELECT batch, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
        'batch_' || CASE WHEN batch < 1000 THEN lpad(CAST(batch AS VARCHAR), 3, '0') ELSE CAST(batch AS VARCHAR) END
        AS directory FROM packed GROUP BY batch""",
)
def pack_totals(spark, folder):
    return packing.batch_totals(packing.pack(p.flat_docs(spark, folder).select("path", "size"), LIMIT))


@query(
    "pack_per_source",
    f"""WITH RECURSIVE {p.FLAT}, {_next_fit('flat', LIMIT, 'source')}
    SELECT grp AS source, path, size, batch FROM packed""",
)
def pack_per_source(spark, folder):
    return packing.pack(p.flat_docs(spark, folder).select("source", "path", "size"), LIMIT, ["source"])


@query(
    "dir_statistics",
    f"""WITH RECURSIVE {p.FLAT}, {_next_fit('flat', 1_048_576)}
    SELECT count(*) AS total_files, sum(size) / 1073741824.0 AS total_size_gb,
        CAST(max(batch) AS BIGINT) AS estimated_subdirs FROM packed""",
)
def dir_statistics(spark, folder):
    return counting.directory_statistics(filters.non_empty(p.flat_docs(spark, folder)), 1_048_576)


@query("dir_type_counts", f"WITH {p.FLAT} SELECT '.' || lang AS ext, count(*) AS n FROM flat GROUP BY 1")
def dir_type_counts(spark, folder):
    rows = filters.non_empty(p.flat_docs(spark, folder))
    return counting.type_counts(rows, names.suffix_label(F.col("name")))


@query(
    "split_plan",
    f"""WITH RECURSIVE {p.FLAT}, {_next_fit('flat', 1_073_741)}
    SELECT path, size, 'out/batch_' || lpad(CAST(batch AS VARCHAR), 3, '0') || '/' || path AS target FROM packed""",
)
def split_plan(spark, folder):
    return split_into_batches(p.flat_docs(spark, folder), "out", 0.001).select("path", "size", "target")


_STEM = "left(name, length(name) - length(lang) - 1)"


@query(
    "flatten_plan",
    f"""WITH {p.DOCS}, named AS (SELECT path, size, lang || '_text.' || lang AS name, lang FROM docs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS i FROM named)
    SELECT path, size, 'out/' || CASE WHEN i = 0 THEN name WHEN i < 1000
        THEN {_STEM} || '_' || lpad(CAST(i AS VARCHAR), 3, '0') || '.' || lang
        ELSE {_STEM} || '_' || i || '.' || lang END AS target FROM ranked""",
)
def flatten_plan(spark, folder):
    """All files of a language share one name, so nearly every target collides."""
    shared = F.concat("lang", F.lit("_text."), "lang")
    rows = p.docs(spark, folder).withColumn("name", shared)
    return flatten(rows, "out").select("path", "size", "target")


@query(
    "flatten_distinct",
    f"WITH {p.DOCS} SELECT path, size, 'out/' || name AS target FROM docs",
)
def flatten_distinct(spark, folder):
    return flatten(p.docs(spark, folder), "out").select("path", "size", "target")


# -- collisions ----------------------------------------------------------------------------

_ENDING = {
    "plain": "'_' || i",
    "padded": "'_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END",
    "chained": "'_' || array_to_string(range(1, i + 1), '_')",
}


def _collide_query(style):
    @query(
        f"collide_{style}",
        f"""WITH {p.SONGS}, ranked AS (
            SELECT *, row_number() OVER (PARTITION BY directory, stem ORDER BY ord) - 1 AS i FROM songs)
        SELECT directory, ord, stem || CASE WHEN i = 0 THEN '' ELSE {_ENDING[style]} END || '.mp3' AS final_name
        FROM ranked""",
    )
    def run(spark, folder):
        found = collisions.resolve(p.songs(spark, folder), "directory", "name", ["ord"], style)
        return found.select("directory", "ord", "final_name")


for _style in collisions.STYLES:
    _collide_query(_style)


@query(
    "collide_vs_existing",
    f"""WITH {p.SONGS}, held AS (SELECT DISTINCT directory, stem FROM songs WHERE brand < 'Brand#2'),
    ranked AS (SELECT s.directory, s.stem, ord, row_number() OVER (PARTITION BY s.directory, s.stem ORDER BY ord) - 1
        + CASE WHEN h.stem IS NULL THEN 0 ELSE 1 END AS i
        FROM songs s LEFT JOIN held h ON s.directory = h.directory AND s.stem = h.stem
        WHERE brand >= 'Brand#2')
    SELECT directory, ord, stem || CASE WHEN i = 0 THEN '' ELSE '_' || i END || '.mp3' AS final_name FROM ranked""",
)
def collide_vs_existing(spark, folder):
    """Names of some brands are in place already; those of all others come in."""
    songs = p.songs(spark, folder)
    held = songs.filter("brand < 'Brand#2'").select("directory", "name")
    found = collisions.resolve(
        songs.filter("brand >= 'Brand#2'"), "directory", "name", ["ord"], "plain", held
    )
    return found.select("directory", "ord", "final_name")


_STEMS = ["a", "a_1", "a", "b", "a_2", "a", "a_1_1", "a_001", "a", "b_1", "a_3", "a_1", "b", "a_1_2", "a_002"]
_STEM_LIST = ", ".join(f"'{s}'" for s in _STEMS)
_STEM_OF = "CAST((p_partkey * 31 + p_size) % 15 AS INTEGER)"


def _styled(style):
    return f"CASE WHEN i = 0 THEN stem ELSE stem || {_ENDING[style]} END"


@query(
    "collide_in_order",
    f"""WITH RECURSIVE claims AS (
        SELECT p_brand AS directory, ([{_STEM_LIST}])[{_STEM_OF} + 1] AS stem, p_partkey AS ord, p_size % 17 = 0 AS held
        FROM part),
    styles(style) AS (VALUES ('plain'), ('padded'), ('chained')),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY directory ORDER BY ord) AS n FROM claims WHERE NOT held),
    walk AS (
        SELECT style, directory, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS name,
            coalesce(list(DISTINCT stem) FILTER (held), CAST([] AS VARCHAR[])) AS taken
        FROM claims, styles GROUP BY style, directory
        UNION ALL
        SELECT style, directory, n, ord, name, list_append(taken, name) FROM (
            SELECT style, w.directory, c.n, c.ord, taken, list_filter(list_transform(range(0, len(taken) + 1), lambda i:
                CASE style WHEN 'plain' THEN {_styled("plain")} WHEN 'padded' THEN {_styled("padded")}
                    ELSE {_styled("chained")} END), lambda c: NOT list_contains(taken, c))[1] AS name
            FROM walk w JOIN numbered c ON c.directory = w.directory AND c.n = w.n + 1))
    SELECT style, directory, ord, name || '.jpg' AS final_name FROM walk WHERE n > 0""",
)
def collide_in_order(spark, folder):
    """Names that look generated, among copies and names in place, served in the given order."""
    stem = F.element_at(F.array(*[F.lit(s) for s in _STEMS]), F.expr(f"{_STEM_OF} + 1"))
    parts = p.table(spark, folder, "part").select(
        F.col("p_brand").alias("directory"),
        F.concat(stem, F.lit(".jpg")).alias("name"),
        F.col("p_partkey").alias("ord"),
        (F.col("p_size") % 17 == 0).alias("held"),
    )
    # every style in directories of its own
    parts = parts.withColumn("style", F.explode(F.array(*[F.lit(s) for s in collisions.STYLES])))
    parts = parts.withColumn("place", F.concat_ws("/", "style", "directory"))
    held, claims = parts.filter("held"), parts.filter("not held")
    found = collisions.resolve(claims, "place", "name", ["ord"], F.col("style"), held)
    return found.select("style", "directory", "ord", "final_name")


# -- by extension ----------------------------------------------------------------------------


@query(
    "batch_chunks",
    f"""WITH {p.DOCS} SELECT path, lang AS ext,
        (row_number() OVER (PARTITION BY lang ORDER BY path) - 1) // 50 AS chunk FROM docs""",
)
def batch_chunks(spark, folder):
    rows = p.docs(spark, folder).select("path", F.col("lang").alias("ext"))
    return batching.chunk(rows, 50)


_MOVES = "CASE WHEN size % 5 = 0 THEN 'skip' ELSE 'move' END"


@query(
    "batch_cap",
    f"""WITH {p.DOCS}, chunks AS (SELECT path, lang AS ext, {_MOVES} AS action,
        (row_number() OVER (PARTITION BY lang ORDER BY path) - 1) // 30 AS chunk FROM docs),
    totals AS (SELECT ext, chunk, count(*) FILTER (action = 'move') AS moved FROM chunks GROUP BY ALL),
    starts AS (SELECT ext, chunk, coalesce(sum(moved) OVER (ORDER BY ext, chunk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM totals)
    SELECT path, ext, chunk, action, before < 500 AS admitted FROM chunks JOIN starts USING (ext, chunk)""",
)
def batch_cap(spark, folder):
    rows = p.docs(spark, folder).select(
        "path", F.col("lang").alias("ext"), F.when(F.col("size") % 5 == 0, "skip").otherwise("move").alias("action")
    )
    return batching.cap_moves(batching.chunk(rows, 30), 500)


_FREE = 300_000


@query(
    "space_gate",
    f"""WITH {p.DOCS}, need AS (SELECT lang, sum(size) * 0.1::DOUBLE AS required FROM docs GROUP BY 1)
    SELECT path, lang AS ext, size, required <= {_FREE} AS fits FROM docs JOIN need USING (lang)""",
)
def space_gate(spark, folder):
    rows = p.docs(spark, folder).select("path", "size", F.col("lang").alias("ext"))
    return batching.space_gate(rows, _FREE)


@query(
    "required_bytes",
    f"""WITH {p.DOCS} SELECT lang AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS total, sum(size) * 1.1::DOUBLE AS required
    FROM docs GROUP BY 1""",
)
def required_bytes(spark, folder):
    rows = p.docs(spark, folder).select("path", "size", F.col("lang").alias("ext"))
    return batching.required_bytes(rows, copy=True)


@query(
    "organize_extensions",
    f"""WITH {p.DOCS}, wanted AS (SELECT path, name, lang, size,
        row_number() OVER (PARTITION BY lang, size ORDER BY path) AS rn FROM docs WHERE lang IN ('de', 'fr')),
    held AS (SELECT lang, size FROM docs WHERE source = 'src0'),
    marked AS (SELECT *, CASE WHEN rn > 1 OR EXISTS (SELECT 1 FROM held h
        WHERE h.lang = w.lang AND h.size = w.size) THEN 'skip' ELSE 'move' END AS action FROM wanted w)
    SELECT path, size, lang AS group_key, action,
        CASE WHEN action = 'move' THEN 'out/' || lang || '_files/' || name END AS target FROM marked""",
)
def organize_extensions(spark, folder):
    """Files of one source are in place already, under other names."""
    rows = p.docs(spark, folder)
    held = rows.filter("source = 'src0'").select(
        names.extension_dir(F.col("lang")).alias("dir"),
        F.concat(F.lit("old-"), "name").alias("name"),
        "size",
    )
    plan = organize_by_extension(
        rows, ["de", "FR", "xyz"], "out", skip_duplicates=True, method="size", existing=held
    )
    return plan.select("path", "size", "group_key", "action", "target")


@query(
    "empty_dirs_after_plan",
    f"""WITH {p.DOCS} SELECT DISTINCT dir FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs e
        WHERE e.dir = d.dir AND e.source NOT IN ('src0', 'src1', 'src2'))""",
)
def empty_dirs_after_plan(spark, folder):
    rows = p.docs(spark, folder).select("rel_path", "source")
    remaining = rows.filter(~F.col("source").isin(p.MOVED))
    return emptiness.left_empty(emptiness.directories_of(rows), remaining)


@query(
    "page_directories",
    f"""WITH {p.PAGES}, parents AS (SELECT DISTINCT string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS parts
        FROM pgs WHERE path LIKE '%/%')
    SELECT DISTINCT array_to_string(parts[1:n], '/') AS dir FROM parents, unnest(range(1, len(parts) + 1)) t(n)""",
)
def page_directories(spark, folder):
    return emptiness.directories_of(p.pages(spark, folder))


@query(
    "curate",
    f"""WITH {p.HASHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY length(path), path) AS rn
        FROM hashed)
    SELECT path, size, CASE WHEN rn > 1 THEN 'remove' WHEN lang IN ('de', 'fr') THEN 'move' ELSE 'keep' END AS action,
        CASE WHEN rn = 1 AND lang IN ('de', 'fr') THEN 'junk/' || lang || '_files/' || name END AS target
    FROM ranked""",
)
def curate(spark, folder):
    plan = curate_plan(p.hashed_docs(spark, folder), "out", p.JUNK, "junk")
    return plan.select("path", "size", "action", "target")
