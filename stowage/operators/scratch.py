"""Tables written between steps.

An operator that reads its input more than once writes the narrow columns it needs to
the shared checkpoint folder first.  The wide source (file contents, long texts) is
then read once, every later pass sees the same rows, and a lost executor costs no more
than a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MARK = "_stowage_saved"
_FACTS = "_stowage_facts"
_FOLDER = "_stowage_folder"
#: Folders saved by the step under way.
_STEP: ContextVar[list[str] | None] = ContextVar("step", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The folder named by the cluster; a local session without one gets its own."""
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="stowage-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/stowage-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, label: str = "rows", **facts: Column) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back.

    ``facts`` are aggregates that the same job takes on the way, with no pass of their own (see ``fact``).
    What the job has shuffled goes when it ends, as nothing reads it again.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    schema = df.schema
    seen = None
    if facts:
        seen = Observation()
        df = df.observe(seen, *[column.alias(name) for name, column in facts.items()])
    if _STEP.get() is not None:
        _STEP.get().append(folder)
    with _shuffles_removed(spark):
        df.write.parquet(folder)
    table = spark.read.schema(schema).parquet(folder)
    setattr(table, _MARK, True)
    setattr(table, _FOLDER, folder)
    setattr(table, _FACTS, (seen, facts))
    return table


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs of the session remove their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def save_step(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``save`` what ``make`` returns, then delete the tables it has saved on the way."""
    outer = _STEP.set([])
    try:
        made = make()
        folders = _STEP.get()
    finally:
        _STEP.reset(outer)
    table = save(made, label)
    for folder in folders:
        _delete(spark, folder)
    return table


def drop(table: DataFrame) -> None:
    """Delete a table written by ``save`` that no result still to be written reads."""
    _delete(table.sparkSession, getattr(table, _FOLDER))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fact(table: DataFrame, name: str, column: Column) -> object:
    """An aggregate of a table: as its ``save`` has seen it, else by a pass over it."""
    seen, facts = getattr(table, _FACTS, (None, {}))
    if seen is not None and name in facts:
        found = seen.get.get(name)
        if found is not None:
            return found
    return table.agg(column).first()[0]


def row_count(table: DataFrame) -> int:
    """Rows of a table, known beforehand if it was saved with ``rows=counted()``."""
    return fact(table, "rows", counted()) or 0


def counted() -> Column:
    """The fact that ``row_count`` looks for: ``save(df, rows=counted())``."""
    return F.count(F.lit(1))


def is_saved(df: DataFrame) -> bool:
    """Whether ``df`` is a table written by ``save``: reading it again costs little."""
    return getattr(df, _MARK, False)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has saved.  Results not yet written are lost."""
    _delete(spark, _app_folder(spark))
