"""The shape of plans and the counters read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stowage.functions import names
from stowage.schema import PLAN_COLUMNS

def as_plan(
    rows: DataFrame,
    target: Column | None = None,
    reason: Column | None = None,
    group_key: Column | None = None,
) -> DataFrame:
    """Rows with path, action and size, laid out as a plan."""

    def text(column: Column | None) -> Column:
        return (F.lit(None) if column is None else column).cast("string")

    return rows.select(
        "path",
        "action",
        text(target).alias("target"),
        text(reason).alias("reason"),
        F.col("size").cast("bigint").alias("size"),
        text(group_key).alias("group_key"),
    ).select(*PLAN_COLUMNS)


def moves_plan(
    settled: DataFrame,
    output: str,
    reason: Column | None = None,
    group_key: Column | None = None,
    action: str = "move",
) -> DataFrame:
    """Plan for rows with path, size, directory and ``final_name``.

    No file system takes a name without ``final_name`` (it is too long): an error.
    """
    fits = F.col("final_name").isNotNull()
    target = names.under(output, F.col("directory"), F.col("final_name"))
    reason = F.lit(None).cast("string") if reason is None else reason
    return as_plan(
        settled.withColumn("action", F.when(fits, action).otherwise("error")),
        F.when(fits, target),
        F.when(fits, reason).otherwise("name too long"),
        group_key,
    )


#: What is counted, in this order.
COUNTERS = (
    "processed", "moved", "skipped", "errors", "skipped_space", "duplicates_skipped", "duplicates_removed",
)

#: Reason of a skipped photo that is no copy of anything.
UNDATED = "no date and no make"


def _counters(plan: DataFrame, where: Column | None = None) -> list[Column]:
    where = F.lit(True) if where is None else where
    moved = F.col("action").isin("move", "copy")
    duplicate = F.col("action").isin("skip", "remove")
    if "reason" in plan.columns:
        duplicate = duplicate & ~F.col("reason").eqNullSafe(UNDATED)
    return [
        F.count_if(where).alias("processed"),
        F.count_if(where & moved).alias("moved"),
        F.count_if(where & (F.col("action") == "skip")).alias("skipped"),
        F.count_if(where & (F.col("action") == "error")).alias("errors"),
        F.count_if(where & (F.col("action") == "skip_space")).alias("skipped_space"),
        F.count_if(where & duplicate).alias("duplicates_skipped"),
        F.count_if(where & (F.col("action") == "remove")).alias("duplicates_removed"),
    ]


def outcome(plan: DataFrame) -> DataFrame:
    """One row of counters.  A removed copy also counts as skipped, as it was not moved; a
    photo without a date is skipped, but no duplicate."""
    return plan.agg(*_counters(plan))


def _extension_of(path: Column) -> Column:
    return names.extension(F.element_at(F.split(path, "/"), -1))


def outcome_by_extension(plan: DataFrame, extensions: list[str]) -> DataFrame:
    """``outcome`` of every extension asked for (``ext``), zeros where no file has it."""
    from stowage.operators.counting import extension_list

    rows = plan.withColumn("ext", _extension_of(F.col("path")))
    counts = rows.groupBy("ext").agg(*_counters(plan))
    listed = extension_list(plan.sparkSession, extensions).join(counts, "ext", "left")
    return listed.fillna(0, [c for c in counts.columns if c != "ext"])


def write_counted(
    plan: DataFrame, folder: str, extensions: list[str] | None = None
) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """Write the plan as Parquet and count it in the same job, with no pass of its own.

    Returns the ``outcome``, and that of every extension asked for; extensions without a file have zeros.
    """
    wanted = names.normalize_extensions(extensions or [])
    metrics = [c.alias(f"all_{i}") for i, c in enumerate(_counters(plan))]
    for j, ext in enumerate(wanted):
        mine = F.coalesce(_extension_of(F.col("path")) == ext, F.lit(False))
        metrics += [c.alias(f"{j}_{i}") for i, c in enumerate(_counters(plan, mine))]
    seen = Observation()
    plan.observe(seen, *metrics).write.parquet(folder)
    found = seen.get
    labels = COUNTERS

    def part(prefix: object) -> dict[str, int]:
        return {label: found[f"{prefix}_{i}"] for i, label in enumerate(labels)}

    return part("all"), {ext: part(j) for j, ext in enumerate(wanted)}


def outcome_by_group(plan: DataFrame) -> DataFrame:
    """Files per group key and action."""
    return plan.groupBy("group_key", "action").agg(F.count("*").alias("files"))
