import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import skew


def hot_rows(spark, n=900):
    """A third of all rows share one key."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", f"p{rng.random():.9f}", i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, p string, i long")


@pytest.mark.parametrize("limit", [None, 10, 100])
def test_numbers_are_those_of_a_sorted_group(spark, limit):
    rows, df = hot_rows(spark)
    found = {r.i: r.rn for r in skew.number_rows(df, ["k"], [F.col("p")], "rn", limit).collect()}
    for key in {r[0] for r in rows}:
        group = sorted((p, i) for k, p, i in rows if k == key)
        assert [found[i] for _, i in group] == list(range(1, len(group) + 1))


@pytest.mark.parametrize("limit", [None, 10])
def test_numbers_over_all_rows(spark, limit):
    rows, df = hot_rows(spark)
    found = {r.i: r.rn for r in skew.number_rows(df, [], [F.desc("p")], "rn", limit).collect()}
    assert [i for _, i in sorted(((p, i) for _, p, i in rows), reverse=True)] == sorted(found, key=found.get)


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_keeps_every_row(spark, limit, how):
    rows, df = hot_rows(spark)
    df = df.withColumn("tags", F.create_map(F.lit("a"), F.col("p")))
    groups = df.filter("k <> 'k1'").groupBy("k").agg(F.count("*").alias("n"), F.max("p").alias("m"))
    found = skew.attach(df, groups, ["k"], "n", how, limit).collect()
    last = {}
    for k, p, _ in rows:
        last[k] = max(p, last.get(k, ""))
    expected = {(k, p, i, None if k == "k1" else last[k]) for k, p, i in rows if how == "left" or k != "k1"}
    assert {(r.k, r.p, r.i, r.m) for r in found} == expected and len(found) == len(expected)


def test_numbers_of_groups_over_many_tasks(spark):
    """Groups without a key, of one row and of many tasks, with few rows a task."""
    rows = [("a", i) for i in range(120)] + [("b", 0)] + [(None, i) for i in range(60)] + [("c", i) for i in range(35)]
    df = spark.createDataFrame(rows, "k string, p long")
    found = skew.number_rows(df, ["k"], [F.col("p")], "rn", 8).collect()
    assert len(found) == len(rows) and all(r.rn == r.p + 1 for r in found)


def test_hot_groups_are_spread(spark):
    """No task of the final join receives a whole hot group."""
    _, df = hot_rows(spark, 3000)
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.attach(df, groups, ["k"], "n", "inner", 100)
        per_task = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) == 4 and max(r[1] for r in per_task) < 500


@pytest.mark.parametrize("limit", [10, 5000])
def test_rows_without_a_key_are_spread(spark, limit):
    """They match nothing, but a third of all rows may be of that kind."""
    _, df = hot_rows(spark, 3000)
    df = df.withColumn("k", F.nullif("k", F.lit("hot")))
    groups = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.attach(df, groups, ["k"], "n", "left", limit)
        assert joined.count() == 3000 and joined.filter("n is null").count() == 1000
        per_task = joined.filter("n is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per_task) == 4 and max(r[1] for r in per_task) < 500


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, p string")
    assert skew.number_rows(df, ["k"], [F.col("p")], "rn").count() == 0
    assert skew.attach(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n").count() == 0


def test_saved_tables_and_their_release(spark, tmp_path):
    from stowage.operators import scratch

    _, df = hot_rows(spark)
    table = scratch.save(df)
    assert scratch.is_saved(table) and not scratch.is_saved(table.filter("i > 1"))
    assert table.count() == 900 and table.schema.names == df.schema.names
    folder = table.inputFiles()[0]
    assert folder.startswith("file://" + spark.conf.get("spark.checkpoint.dir"))
    scratch.release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        table.collect()
    assert scratch.save(df).count() == 900
