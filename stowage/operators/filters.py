"""Row filters on a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import globs, names
from stowage.schema import MEDIA_FAMILIES


def visible(df: DataFrame, rel_path: str = "rel_path") -> DataFrame:
    return df.filter(~names.is_hidden(F.col(rel_path)))


def include_globs(df: DataFrame, patterns: Sequence[str] | None, name: str = "name") -> DataFrame:
    """Keep names that match any pattern; no patterns, no filter."""
    return df.filter(globs.matches_any(F.col(name), patterns)) if patterns else df


def exclude_globs(df: DataFrame, patterns: Sequence[str] | None, name: str = "name") -> DataFrame:
    return df.filter(~globs.matches_any(F.col(name), patterns)) if patterns else df


def with_extensions(df: DataFrame, extensions: list[str], name: str = "name") -> DataFrame:
    """Rows whose extension was asked for, with it in ``ext``."""
    wanted = names.normalize_extensions(extensions)
    return df.withColumn("ext", names.extension(F.col(name))).filter(F.col("ext").isin(wanted))


def media(df: DataFrame, family: str, name: str = "name") -> DataFrame:
    return df.filter(F.lower(names.suffix_of(F.col(name))).isin(MEDIA_FAMILIES[family]))


def at_depth(df: DataFrame, depth: int) -> DataFrame:
    """1: direct children of the root; 2: files of its direct subdirectories."""
    return df.filter(F.col("depth") == depth)


def non_empty(df: DataFrame, size: str = "size") -> DataFrame:
    """Also drops files whose size could not be read."""
    return df.filter(F.col(size) > 0)


def readable(df: DataFrame, digest: str = "hash") -> DataFrame:
    return df.filter(F.col(digest).isNotNull())
