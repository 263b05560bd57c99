from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowage.operators import duplicates
from stowage.plans.common import outcome
from stowage.plans.dedupe import dedupe, dedupe_contents

NOW = datetime(2024, 5, 1)


def digests(spark, rows):
    """rows: (path, hash[, mtime offset])."""
    full = [(r[0], 10, NOW + timedelta(seconds=r[2] if len(r) > 2 else 0), r[1]) for r in rows]
    return spark.createDataFrame(full, "path string, size long, mtime timestamp, hash string")


def keepers(plan):
    return {r.path for r in plan.filter("action = 'keep'").collect()}


@pytest.mark.parametrize(
    "strategy, rows, kept",
    [
        ("shortest_path", [("very/long/path/to/file.txt", "h"), ("short/file.txt", "h"), ("file.txt", "h")], "file.txt"),
        ("oldest", [("old.txt", "h", -100), ("newer.txt", "h", -90), ("newest.txt", "h", -80)], "old.txt"),
        ("newest", [("old.txt", "h", -100), ("newer.txt", "h", -90), ("newest.txt", "h", -80)], "newest.txt"),
        ("largest_name", [("deep/down/ab.t", "h"), ("abc.t", "h"), ("a.t", "h")], "abc.t"),
        ("first_alphabetical", [("zebra.t", "h"), ("Apple.t", "h"), ("banana.t", "h")], "Apple.t"),
        ("shortest_path", [("b.t", "h"), ("a.t", "h")], "a.t"),
    ],
)
@pytest.mark.parametrize("group_rows", [None, 1])
def test_keeper(spark, strategy, rows, kept, group_rows):
    plan = dedupe(digests(spark, rows + [("alone", "x")]), strategy, group_rows)
    assert keepers(plan) == {kept, "alone"}
    assert plan.count() == len(rows) + 1


def test_unknown_strategy_warns(spark):
    with pytest.warns(UserWarning, match="shortest_path"):
        plan = dedupe(digests(spark, [("aa", "h"), ("b", "h")]), "luck")
    assert keepers(plan) == {"b"}


def test_totals_and_sets(spark):
    df = digests(spark, [("d1", "h"), ("d2", "h"), ("d3", "h"), ("u", "x"), ("bad", None)])
    row = duplicates.totals(df).first()
    assert row.asDict() == dict(files=4, unique_hashes=2, duplicate_sets=1, to_remove=2, freed_bytes=20)
    sets = duplicates.duplicate_sets(df).collect()
    assert [(s.n, s.keep_path, s.freed_bytes) for s in sets] == [(3, "d1", 20)]
    assert {r.path for r in duplicates.set_members(df).collect()} == {"d1", "d2", "d3"}


def test_files_without_digest_are_errors(spark):
    df = digests(spark, [("a", None), ("b", None), ("c", "h")])
    plan = {r.path: r.action for r in dedupe(df).collect()}
    assert plan == {"a": "error", "b": "error", "c": "keep"}


def test_three_batches(spark):
    names = ["sunset", "mountain", "beach", "family", "concert"]
    rows = [(f"b1/{n}", n) for n in names] + [(f"b2/{n}", n) for n in names[:3]] + [("b2/solo", "s")]
    rows += [(f"b3/{n}", n) for n in names[3:]] + [("b3/x", "x"), ("b3/y", "y")]
    df = digests(spark, rows)
    row = duplicates.totals(df).first()
    assert (row.files, row.duplicate_sets, row.to_remove) == (13, 5, 5)
    assert len(keepers(dedupe(df))) == 8


@pytest.mark.parametrize("group_rows", [None, 50])
def test_one_hot_set(spark, group_rows):
    """All empty files are one set; here they are a third of the collection."""
    rows = [(f"f{i:04d}", "empty" if i % 3 == 0 else f"h{i}") for i in range(600)]
    plan = dedupe(digests(spark, rows), group_rows=group_rows)
    facts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
    assert facts == {"keep": 401, "remove": 199}
    assert "f0000" in keepers(plan)


def test_contents(spark):
    df = spark.createDataFrame([("a", "Hello, World!"), ("bb", "Hello, World!")], "path string, text string")
    df = df.withColumn("size", F.length("text")).withColumn("mtime", F.lit(NOW))
    rows = dedupe_contents(df, "text").orderBy("path").collect()
    assert [r.action for r in rows] == ["keep", "remove"]
    assert rows[0].group_key.startswith("dffd6021")
    assert rows[1].reason == "copy of a"


@pytest.mark.parametrize("group_rows", [None, 1])
def test_against_saved_digests(spark, group_rows):
    flagged = duplicates.against_digests(
        digests(spark, [("a", "h"), ("b", "x"), ("c", None)]),
        digests(spark, [("old", "h"), ("old2", "h")]),
        group_rows,
    )
    assert {r.path: r.known for r in flagged.collect()} == {"a": True, "b": False, "c": False}


# -- incoming files ------------------------------------------------------------------------


def contents(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select(
        "path", F.lit("py_files").alias("directory"), F.length("text").cast("long").alias("size"),
        F.md5("text").alias("hash"),
    )


@pytest.mark.parametrize("group_rows", [None, 1])
@pytest.mark.parametrize(
    "held, incoming, method, remove, moved, skipped, removed",
    [
        (["hello"], ["hello", "world"], "hash", False, 1, 1, 0),
        (["hello"], ["hello", "world"], "hash", True, 1, 1, 1),
        (["hello", "world"], ["hello", "hello", "world", "unique"], "hash", True, 1, 3, 3),
        (["hello"], ["world"], "size", False, 0, 1, 0),
        (["hello"], ["world", "hello"], "both", False, 1, 1, 0),
        ([], ["x", "x", "y"], "hash", False, 2, 1, 0),
        ([], ["x", "y"], "size", False, 1, 1, 0),
    ],
)
def test_incoming(spark, held, incoming, method, remove, moved, skipped, removed, group_rows):
    marked = duplicates.mark_incoming(
        contents(spark, [(f"i{n}", t) for n, t in enumerate(incoming)]),
        contents(spark, [(f"e{n}", t) for n, t in enumerate(held)]),
        "directory", method, remove=remove, group_rows=group_rows,
    )
    row = outcome(marked).first()
    assert (row.processed, row.moved) == (len(incoming), moved)
    assert (row.duplicates_skipped, row.duplicates_removed) == (skipped, removed)


def test_existing_only(spark):
    marked = duplicates.mark_incoming(
        contents(spark, [("a", "x"), ("b", "x")]), contents(spark, []), "directory", "hash", vs_existing_only=True
    )
    assert outcome(marked).first().moved == 2


def test_unreadable_files_match_nothing(spark):
    unread = contents(spark, [("a", None), ("b", None)])
    marked = duplicates.mark_incoming(unread, unread, "directory", "hash")
    assert {r.action for r in marked.collect()} == {"error"}
