"""Reports as rows: a ``line`` of text and the columns that put lines in order.

Nothing is gathered: a set or file with any number of lines stays spread over tasks,
and ``write_lines`` sorts the lines into consecutive text parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import names, sizes
from stowage.operators import counting, duplicates
from stowage.operators.scratch import counted, fact, is_saved, row_count, save
from stowage.operators.skew import attach
from stowage.plans import common

# The lines of the reports, which other tools may read.
_RULE = "=" * 50
_NO_FILES = "No files found in the directory."
_TYPES_HEAD = "File Type Count Summary (Total: {} files)"
_TYPE_LINE = " : %6d files (%5.1f%%)"
_TYPE_EXAMPLE = "    └── "
_TYPE_REST = "    └── ... and %d more"
_SETS_HEAD = (
    "DUPLICATE FILES REPORT",
    _RULE,
    "Generated: {generated}",
    "Total files scanned: {files}",
    "Duplicate sets found: {sets}",
    "Duplicate files to remove: {extra}",
    "Space to be saved: {freed:.2f} GB",
    "",
)
_SET_LINES = ("Duplicate Set #", "Hash: ", "Files (", "):")
_SET_FILE = "  - %s (%.1f MB)"
_TAG_RULE = "=" * 10
_NO_TAGS = "No EXIF data found."
_TAG_ERROR = "Error reading EXIF from "


def write_lines(report: DataFrame, folder: str) -> None:
    """Text parts whose concatenation, in name order, is the report."""
    order = [c for c in report.columns if c != "line"]
    report.orderBy(*order).select("line").write.text(folder)


# -- types -----------------------------------------------------------------------------


def type_report(df: DataFrame, details: bool = False, limit: int = 10, path: str = "rel_path") -> DataFrame:
    """Lines (section, rank, ext, kind, place, line): a header, then a line per extension,
    most frequent first, with up to ``limit`` example paths if ``details``."""
    spark = df.sparkSession
    paths = save(counting.type_paths(df, path), "paths") if details else df
    label = F.col("ext") if details else names.extension_label(F.col("name"))
    counts = save(counting.type_counts(paths, label), "counts")
    total = counts.agg(F.sum("n")).first()[0]
    shape = "section int, rank long, ext string, kind int, place long, line string"
    if not total:
        return spark.createDataFrame([(0, 0, "", 0, 0, _NO_FILES)], shape)
    header = spark.createDataFrame(
        [
            (0, 0, "", 0, 0, _TYPES_HEAD.format(total)),
            (0, 0, "", 0, 1, _RULE),
        ],
        shape,
    )
    shown = names.display_label(F.col("ext"))
    shown = F.rpad(shown, F.greatest(F.length(shown), F.lit(15)), F.lit(" "))
    share = sizes.percent(F.col("n"), F.lit(total))
    text = F.concat(shown, F.format_string(_TYPE_LINE, "n", share))

    def body(kind: int, place: Column, line: Column) -> list[Column]:
        return [
            F.lit(1).alias("section"),
            (-F.col("n")).alias("rank"),
            "ext",
            F.lit(kind).alias("kind"),
            place.cast("bigint").alias("place"),
            line.alias("line"),
        ]

    report = header.unionByName(counts.select(*body(0, F.lit(0), text)))
    if not details:
        return report
    examples = counting.first_paths(paths, limit).join(counts, "ext")
    example = F.concat(F.lit(_TYPE_EXAMPLE), "path")
    rest = F.format_string(_TYPE_REST, F.col("n") - limit)
    return (
        report.unionByName(examples.select(*body(1, F.col("rank"), example)))
        .unionByName(counts.filter(F.col("n") > limit).select(*body(2, F.lit(0), rest)))
        .unionByName(counts.select(*body(3, F.lit(0), F.lit(""))))
    )


# -- duplicates ------------------------------------------------------------------------


def _duplicate_sets(digests: DataFrame) -> DataFrame:
    """The sets, written once, with their totals taken on the way."""
    return save(
        duplicates.duplicate_sets(digests),
        "sets",
        rows=counted(),
        extra=F.sum(F.col("n") - 1),
        freed=F.sum("freed_bytes"),
    )


def set_listing(
    digests: DataFrame, group_rows: int | None = None, sets: DataFrame | None = None
) -> DataFrame:
    """Rows (set_no, hash, n, path, megabytes) of all duplicate sets, in digest order.

    ``sets`` are the duplicate sets of ``digests``, if they are known.
    """
    sets = _duplicate_sets(digests) if sets is None else sets
    numbered = duplicates.numbered_sets(sets, group_rows)
    listed = attach(digests, numbered.select("hash", "n", "set_no"), ["hash"], "n", group_rows=group_rows)
    return listed.select(
        "set_no", "hash", "n", "path", sizes.megabytes(F.col("size")).alias("megabytes")
    )


def duplicate_report(digests: DataFrame, generated: str, group_rows: int | None = None) -> DataFrame:
    """Lines (set_no, kind, path, line); the space is what the default plan frees."""
    spark = digests.sparkSession
    known = _duplicate_sets(digests)
    files = digests.filter("hash is not null").count()
    extra = fact(known, "extra", F.sum(F.col("n") - 1)) or 0
    freed = fact(known, "freed", F.sum("freed_bytes")) or 0
    listing = save(set_listing(digests, group_rows, known), "listing")
    shape = "set_no long, kind int, path string, line string"
    facts = {"generated": generated, "files": files, "sets": row_count(known), "extra": extra}
    header = [line.format(**facts, freed=freed / sizes.GIB) for line in _SETS_HEAD]
    top = spark.createDataFrame([(0, i, "", text) for i, text in enumerate(header)], shape)
    sets = listing.select("set_no", "hash", "n").distinct()
    blank = F.lit("").alias("path")
    heads = sets.select(
        "set_no",
        F.posexplode(
            F.array(
                F.concat(F.lit(_SET_LINES[0]), F.col("set_no").cast("string")),
                F.concat(F.lit(_SET_LINES[1]), "hash"),
                F.concat(F.lit(_SET_LINES[2]), F.col("n").cast("string"), F.lit(_SET_LINES[3])),
            )
        ).alias("kind", "line"),
    ).select("set_no", "kind", blank, "line")
    entry = F.format_string(_SET_FILE, "path", "megabytes")
    files = listing.select("set_no", F.lit(3).alias("kind"), "path", entry.alias("line"))
    ends = sets.select("set_no", F.lit(4).alias("kind"), blank, F.lit("").alias("line"))
    return top.unionByName(heads).unionByName(files).unionByName(ends)


# -- tags ------------------------------------------------------------------------------


def tag_dump(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Lines (name, path, place, line) for every file of ``files``, tags or not.

    ``files`` may carry ``tag_error`` text, shown in place of the tags.
    """
    error = F.col("tag_error") if "tag_error" in files.columns else F.lit(None).cast("string")
    files = files.select("path", "name", error.alias("tag_error"))
    good = F.col("tag_error").isNull()

    def lines(rows: DataFrame, place: Column, line: Column) -> DataFrame:
        return rows.select("name", "path", place.cast("int").alias("place"), line.alias("line"))

    tags = tags if is_saved(tags) else save(tags.select("path", "pos", "tag", "value"), "tags")
    counts = tags.groupBy("path").agg(F.count("*").alias("n"))
    files = save(files.join(counts, "path", "left"), "files")
    readable = files.filter(good)
    tagged = attach(tags, readable.filter("n > 0").select("path", "name", "n"), ["path"], "n")
    shown = F.concat(F.col("tag"), F.lit(": "), F.col("value"))
    failed = F.concat(F.lit(_TAG_ERROR), "path", F.lit(": "), "tag_error")
    return (
        lines(readable, F.lit(-2), F.lit(_TAG_RULE))
        .unionByName(lines(readable, F.lit(-1), F.col("name")))
        .unionByName(lines(tagged, F.col("pos"), shown))
        .unionByName(lines(readable.filter("n is null"), F.lit(0), F.lit(_NO_TAGS)))
        .unionByName(lines(files.filter(~good), F.lit(0), failed))
    )


# -- run summary -----------------------------------------------------------------------


def summary_lines(plan: DataFrame | dict[str, int]) -> list[str]:
    """Counters of a plan, one line each; ``plan`` may be the counters that ``write_counted`` returned."""
    facts = plan if isinstance(plan, dict) else common.outcome(plan).first().asDict()
    labels = {
        "processed": "Total files processed",
        "moved": "Files moved",
        "skipped": "Files skipped",
        "errors": "Errors",
        "skipped_space": "Skipped for lack of space",
        "duplicates_skipped": "Duplicates skipped",
        "duplicates_removed": "Duplicates removed from source",
    }
    return [f"{label}: {facts[key]}" for key, label in labels.items()]
