"""Content digests, of columns and of files, and tables of digests kept between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.names import path_decoder
from stowage.operators.scan import Rule, scan
from stowage.operators.scratch import counted, fact, save
from stowage.operators.skew import attach
from stowage.sources import jsonblocks

ALGORITHMS = ("sha256", "md5", "sha1")

#: Members of the metadata of a JSON digest file.
METADATA = ("algorithm", "generated", "total_files")

#: Bytes one hashing task should read, big single files aside, ...
TASK_BYTES = 1 << 30
#: ... where opening a file counts as so many.
OPEN_BYTES = 4 << 20
#: Rows of a manifest whose costs one task sums up; it holds them with all their columns.
COST_ROWS = 25_000


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Digest of a text or binary column, computed in the JVM."""
    if algorithm == "sha256":
        return F.sha2(content, 256)
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}")


def _file_digest(algorithm: str):
    decode = path_decoder()

    def digest_files(batches):
        import hashlib

        import pandas as pd

        for paths in batches:
            hashes, errors = [], []
            for path in paths:
                try:
                    with open(decode(path), "rb") as stream:
                        hashes.append(hashlib.file_digest(stream, algorithm).hexdigest())
                    errors.append(None)
                except (OSError, ValueError) as error:
                    hashes.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"hash": hashes, "read_error": errors})

    from collections.abc import Iterator

    import pandas as pd

    digest_files.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(digest_files, "hash string, read_error string")


class _Cost(Rule):
    """``upto``: what all files up to this one cost."""

    reads = ("cost",)
    adds = T.StructType([T.StructField("upto", T.LongType())])
    start = 0

    def fold(self, state, rows):
        out = []
        for (cost,) in rows:
            state += cost
            out.append((state,))
        return out

    def summary(self, rows):
        return sum(cost for (cost,) in rows)

    def advance(self, state, summary):
        return state + summary


def balanced(manifest: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``manifest``, written once and dealt to tasks of equal cost: bytes to read, and files to open.

    The order of paths is cut where the cost so far passes a multiple of a task's share, so a task gets its
    share and at most one file more.
    """
    spark = manifest.sparkSession
    cost = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)) + F.lit(OPEN_BYTES)
    costs = manifest.select(F.struct("*").alias("row"), F.col(path).alias("at"), cost.alias("cost"))
    costs = save(costs, "costs", rows=counted(), total=F.sum("cost"))
    total = fact(costs, "total", F.sum("cost")) or 0
    share = min(TASK_BYTES, total // spark.sparkContext.defaultParallelism + 1)
    placed = scan(costs, [], [F.col("at")], _Cost(), COST_ROWS)
    task = F.expr(f"cast((upto - 1) div {share}L as int)")
    return placed.repartitionById(total // share + 1, task).select("row.*")


def hash_files(manifest: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Add ``hash``; unreadable files get null and their ``read_error``.

    Only paths travel to Python, which reads each file in constant memory.  Tasks are ``balanced`` by what
    they read, so neither big files nor very many small ones pile up in one task.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}")
    kept = [c for c in manifest.columns if c not in ("hash", "read_error")]
    return (
        balanced(manifest.select(*kept))
        .withColumn("_digest", _file_digest(algorithm)("path"))
        .select(*kept, F.col("_digest.hash").alias("hash"), F.col("_digest.read_error").alias("read_error"))
    )


def same_size_only(manifest: DataFrame, size: str = "size", group_rows: int | None = None) -> DataFrame:
    """Files whose size is unknown or occurs more than once: no other file can have a copy."""
    unknown = manifest.filter(F.col(size).isNull())
    manifest = manifest.filter(F.col(size).isNotNull())
    sizes = manifest.groupBy(size).agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = attach(manifest, sizes, [size], "_n", group_rows=group_rows)
    return shared.select(*manifest.columns).unionByName(unknown)


# -- digest tables -------------------------------------------------------------------


def load_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Columns hash, path, algorithm, generated."""
    return spark.read.parquet(folder)


def approximate_unique(sketches: DataFrame) -> DataFrame:
    """One row (files, unique_hashes): what the sketches of any number of scans say together.

    The number of different digests is an estimate (``sinks.digests.RELATIVE_ERROR``); a file that is in two scans
    counts as a file twice.
    """
    merged = sketches.agg(F.sum("files").alias("files"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("unique_hashes"),
    )


def load_sketches(spark: SparkSession, *folders: str) -> DataFrame:
    """The sketches kept next to digest tables."""
    return spark.read.parquet(*[f"{folder.rstrip('/')}_sketch" for folder in folders])


def load_digests_json(spark: SparkSession, file: str) -> tuple[DataFrame, dict[str, str]]:
    """Read a JSON digest file of any layout, or a folder with its parts, by many tasks.

    Returns the rows (hash, path), written once, and the metadata.
    """
    found = save(jsonblocks.read(spark, file), "json")
    facts = found.filter("kind = 'fact'").groupBy("key").agg(F.min("value").alias("value"))
    wanted = facts.filter(F.col("key").isin(*METADATA))  # three rows at most
    metadata = {r.key: r.value for r in wanted.collect()}
    if not metadata:
        raise ValueError(f"{file}: no JSON digest file")
    return found.filter("kind = 'path'").select(F.col("key").alias("hash"), F.col("value").alias("path")), metadata
