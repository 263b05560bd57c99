"""Counts by type and statistics of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import names, sizes
from stowage.operators import packing
from stowage.operators.scratch import save


def type_counts(df: DataFrame, label: Column | None = None) -> DataFrame:
    """(ext, n) per extension label, most frequent first."""
    label = names.extension_label(F.col("name")) if label is None else label
    counts = df.groupBy(label.alias("ext")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "ext")


def type_share(df: DataFrame, label: Column | None = None) -> DataFrame:
    """(ext, n, share): percentage of all files."""
    counts = type_counts(df, label)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("ext", "n", sizes.percent(F.col("n"), total.scalar()).alias("share"))


def type_paths(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """(ext, path) in row form: a list per extension has no bound."""
    return df.select(names.extension_label(F.col("name")).alias("ext"), F.col(path).alias("path"))


def type_examples(df: DataFrame, limit: int = 10, path: str = "rel_path") -> DataFrame:
    """First paths of every extension, with the number of further ones in ``more``."""
    return first_paths(type_paths(df, path), limit)


def first_paths(paths: DataFrame, limit: int) -> DataFrame:
    """``type_examples`` for rows (ext, path).

    The rank filter is applied inside each task before the shuffle, so a task sends at
    most ``limit`` rows per extension.
    """
    counts = paths.groupBy("ext").agg(F.count("*").alias("n"))
    first = Window.partitionBy("ext").orderBy("path")
    top = paths.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    more = F.greatest(F.col("n") - limit, F.lit(0)).alias("more")
    return top.join(counts, "ext").select("ext", F.col("rank").cast("bigint").alias("rank"), "path", more)


def extension_list(spark: SparkSession, extensions: list[str]) -> DataFrame:
    wanted = names.normalize_extensions(extensions)
    return spark.createDataFrame([(e,) for e in wanted], "ext string")


def requested_counts(df: DataFrame, extensions: list[str]) -> DataFrame:
    """(ext, n) for every extension asked for, 0 where no file has it."""
    wanted = names.normalize_extensions(extensions)
    counts = (
        df.groupBy(names.extension(F.col("name")).alias("ext"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("ext").isin(wanted))
    )
    return (
        extension_list(df.sparkSession, extensions)
        .join(counts, "ext", "left")
        .select("ext", F.coalesce("n", F.lit(0)).alias("n"))
    )


def directory_statistics(df: DataFrame, limit: int) -> DataFrame:
    """One row: files, total GB and the batches they would need below ``limit`` bytes.

    Empty files don't count.  All comes from one histogram of sizes, written in one pass.
    """
    counts = packing.histogram(df)
    facts = counts.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    batches = packing.batches_needed(counts, limit)
    both = facts.unionByName(batches, allowMissingColumns=True)
    return both.agg(
        F.coalesce(F.max("files"), F.lit(0)).alias("total_files"),
        sizes.gigabytes(F.coalesce(F.max("bytes"), F.lit(0))).alias("total_size_gb"),
        F.max("batches").alias("estimated_subdirs"),
    )


def collection_statistics(df: DataFrame, limit: int) -> DataFrame:
    """``directory_statistics`` and the files of every type in one result and one pass.

    One row a type (``ext``, ``n``), and one with ``ext`` null and the facts of all of them.
    """
    narrow = df.filter("size > 0").select(names.suffix_label(F.col("name")).alias("ext"), "size")
    counts = save(narrow.groupBy("ext", "size").agg(F.count("*").alias("n")), "type_sizes")
    by_size = save(counts.groupBy("size").agg(F.sum("n").alias("n")), "histogram")
    types = counts.groupBy("ext").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    facts = types.groupBy().agg(F.sum("n").alias("total_files"), F.sum("bytes").alias("bytes"))
    both = facts.unionByName(packing.batches_needed(by_size, limit), allowMissingColumns=True)
    whole = both.agg(
        F.coalesce(F.max("total_files"), F.lit(0)).alias("n"),
        sizes.gigabytes(F.coalesce(F.max("bytes"), F.lit(0))).alias("size_gb"),
        F.max("batches").alias("estimated_subdirs"),
    ).withColumn("ext", F.lit(None).cast("string"))
    rows = types.select("ext", "n", sizes.gigabytes(F.col("bytes")).alias("size_gb"))
    return rows.unionByName(whole, allowMissingColumns=True)
