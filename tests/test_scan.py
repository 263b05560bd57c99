import random

import pytest
from pyspark.sql import functions as F

from stowage.operators.collisions import _Skips
from stowage.operators.scan import scan


@pytest.mark.parametrize("range_rows", [None, 7])
def test_groups_over_many_ranges_fold_like_a_loop(spark, range_rows):
    rng = random.Random(2)
    rows = [(f"g{rng.randint(0, 5)}", i, rng.randint(-3, 60)) for i in range(300)]
    rows += [("hot", i, rng.randint(0, 200)) for i in range(300)] + [(None, 1, 5), ("one", 0, 1)]
    expected, state = {}, {}
    for key, i, due in rows:
        s = state.get(key, 0)
        expected[key, i] = (s, s < due)
        state[key] = s + (s < due)
    table = spark.createDataFrame(rows, "key string, i long, due long").repartition(5)
    found = scan(table, ["key"], [F.col("i")], _Skips(), range_rows)
    assert found.columns == ["key", "i", "due", "before", "skipped"]
    assert {(r.key, r.i): (r.before, r.skipped) for r in found.collect()} == expected
    assert scan(table.limit(0), ["key"], [F.col("i")], _Skips(), range_rows).count() == 0


def test_a_summary_does_what_its_rows_do():
    rng, rule = random.Random(3), _Skips()
    for _ in range(200):
        rows = [(rng.randint(-4, 30),) for _ in range(rng.randint(0, 25))]
        summary = rule.summary(rows)
        for start in range(0, 35):
            state = start
            for (due,) in rows:
                state += state < due
            assert rule.advance(start, summary) == state
