"""Tags as tables.  Decoders stay outside: Spark starts from what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROBE = "format struct<tags:map<string,string>>, _corrupt_record string"


def read_probe(df: DataFrame, probe: str, tags: str = "tags", failed: str = "failed") -> DataFrame:
    """Add the container tags of a probe's JSON and whether the probe failed.

    No output and output that is no JSON object are failures; an object without tags is
    not, its tags are an empty map.  Every document is parsed once.
    """
    parsed = F.from_json(F.col(probe), _PROBE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    none = F.create_map().cast("map<string,string>")
    is_object = F.coalesce(probe, F.lit("")).rlike(r"\A\s*\{")
    return (
        df.withColumn("_probe", parsed)
        .withColumn(tags, F.coalesce("_probe.format.tags", none))
        .withColumn(failed, ~is_object | F.col("_probe._corrupt_record").isNotNull())
        .drop("_probe")
    )


def first_of_list(values: Column) -> Column:
    """First item of a list value; an empty list counts as a missing tag."""
    return F.try_element_at(values, F.lit(1))


def explode_tags(df: DataFrame, path: str, tags: str) -> DataFrame:
    """Rows (path, pos, tag, value) from a MAP column, in stored order."""
    return df.select(F.col(path).alias("path"), F.posexplode(tags).alias("pos", "tag", "value"))
