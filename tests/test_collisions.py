import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage.operators import collisions


def split(name):
    dot = name.rfind(".")
    return (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")


def candidate(name, index, style):
    if not index:
        return name
    stem, suffix = split(name)
    if style == "plain":
        return f"{stem}_{index}{suffix}"
    if style == "padded":
        return f"{stem}_{index:03d}{suffix}"
    return f"{stem}_{'_'.join(map(str, range(1, index + 1)))}{suffix}"


def sequential(claims, existing, style):
    """Claims one after the other, each taking the first free candidate."""
    taken, result = set(existing), {}
    for directory, name, order in sorted(claims, key=lambda c: c[2]):
        index = 0
        while (directory, candidate(name, index, style)) in taken:
            index += 1
        result[order] = candidate(name, index, style)
        taken.add((directory, result[order]))
    return result


def resolved(spark, claims, existing, style, **options):
    df = spark.createDataFrame(claims, "d string, n string, o long")
    held = spark.createDataFrame(existing, "d string, n string")
    rows = collisions.resolve(df, "d", "n", ["o"], style, held, **options).collect()
    return {r.o: r.final_name for r in rows}


@pytest.mark.parametrize(
    "style, existing, incoming, expected",
    [
        ("padded", ["duplicate.txt"], ["duplicate.txt"], ["duplicate_001.txt"]),
        ("padded", ["m.txt", "m_001.txt", "m_002.txt"], ["m.txt"], ["m_003.txt"]),
        ("padded", ["image.jpg"], ["image.jpg", "image.png"], ["image_001.jpg", "image.png"]),
        ("plain", ["test.py"], ["test.py"], ["test_1.py"]),
        ("chained", ["test.jpg"], ["test.jpg"], ["test_1.jpg"]),
        ("chained", [], ["a.t"] * 4, ["a.t", "a_1.t", "a_1_2.t", "a_1_2_3.t"]),
        ("padded", [], ["a.txt", "b.txt"], ["a.txt", "b.txt"]),
        ("plain", [], ["README", "README", ".rc", ".rc"], ["README", "README_1", ".rc", ".rc_1"]),
        ("padded", ["a.txt"], ["a.txt", "a_001.txt"], ["a_001.txt", "a_001_001.txt"]),
        ("padded", ["a.txt"], ["a_001.txt", "a.txt"], ["a_001.txt", "a_002.txt"]),
        ("plain", [], ["a", "a", "a_1", "a_1_1", "a_1"], ["a", "a_1", "a_1_1", "a_1_1_1", "a_1_2"]),
        ("chained", [], ["a", "a", "a_1", "a", "a_1_2"], ["a", "a_1", "a_1_1", "a_1_2", "a_1_2_1"]),
    ],
)
def test_known_names(spark, style, existing, incoming, expected):
    claims = [("x", n, i) for i, n in enumerate(incoming)]
    found = resolved(spark, claims, [("x", n) for n in existing], style)
    assert [found[i] for i in range(len(incoming))] == expected


def names_pool(style):
    bases = ["a.t", "b", "a_x.t", "c.d.t", ".rc"]
    pool = list(bases)
    for base in bases:
        pool += [candidate(base, i, style) for i in (1, 2, 3, 5)]
    pool += [candidate(candidate("a.t", 1, style), i, style) for i in (1, 2)]
    pool += ["a_01.t", "a_0.t", "_1.t", "a_1_3.t", "a_2_2.t"]
    return pool


@pytest.mark.parametrize("style", collisions.STYLES)
@pytest.mark.parametrize("group_rows", [None, 2])
def test_names_equal_the_sequential_loop(spark, style, group_rows):
    """Many small directories at once, each resolved on its own."""
    rng = random.Random(f"{style}")
    pool = names_pool(style)
    claims, existing = [], set()
    for d in range(60):
        some = rng.sample(pool, rng.randint(1, 8))
        for _ in range(rng.randint(1, 14)):
            claims.append((f"d{d}", rng.choice(some), len(claims)))
        existing |= {(f"d{d}", rng.choice(pool)) for _ in range(rng.randint(0, 4))}
    expected = sequential(claims, existing, style)
    found = resolved(spark, claims, sorted(existing), style, group_rows=group_rows)
    assert found == expected
    final = [(c[0], found[c[2]]) for c in claims]
    assert len(set(final)) == len(final) and not set(final) & existing


def test_one_hot_name(spark):
    """A third of all rows claim one name; its copies are numbered over many tasks."""
    claims = [("x", "hot.t" if i % 3 == 0 else f"n{i}.t", i) for i in range(900)]
    found = resolved(spark, claims, [("x", "hot_7.t")], "plain", group_rows=50)
    hot = [found[i] for i in range(0, 900, 3)]
    assert hot[:8] == ["hot.t", "hot_1.t", "hot_2.t", "hot_3.t", "hot_4.t", "hot_5.t", "hot_6.t", "hot_8.t"]
    assert len(set(hot)) == 300


def test_a_hot_base_among_names_that_look_generated(spark):
    """Copies and natural names of one base, in random order and over many tasks."""
    rng = random.Random(4)
    names = ["h.t"] * 150 + [f"h_{rng.randint(1, 200)}.t" for _ in range(150)]
    names += [f"h_{rng.randint(1, 5)}_{rng.randint(1, 4)}.t" for _ in range(40)]
    rng.shuffle(names)
    claims = [("x", n, i) for i, n in enumerate(names)]
    existing = [("x", f"h_{i}.t") for i in range(3, 90, 7)]
    found = resolved(spark, claims, existing, "plain", group_rows=20)
    assert found == sequential(claims, existing, "plain")


def test_unknown_style(spark):
    df = spark.createDataFrame([("x", "a", 1)], "d string, n string, o long")
    with pytest.raises(ValueError):
        collisions.resolve(df, "d", "n", ["o"], "roman")


def test_names_that_no_file_system_takes(spark):
    claims = [("x", "a.jpg", i) for i in range(120)] + [("x", "b_999999999999999999.jpg", 120)]
    found = resolved(spark, claims, [], "chained", longest=255)
    whole = resolved(spark, claims, [], "chained")
    assert found == {o: n if len(n) <= 255 else None for o, n in whole.items()}
    assert 80 < sum(n is not None for n in found.values()) < 100
    plain = resolved(spark, [("x", "a.jpg", i) for i in range(300)], [], "plain", longest=255)
    assert plain[299] == "a_299.jpg"


def test_long_chains_are_dealt_out_by_their_bytes(spark, monkeypatch):
    """600 chains of one base are 660 KB, which no task spells alone; names beyond the text are spelled on."""
    monkeypatch.setattr(collisions, "TASK_BYTES", 50_000, raising=False)
    monkeypatch.setattr(collisions, "TEXT_INDICES", 250, raising=False)
    claims = [("x", "a.jpg", i) for i in range(600)] + [("x", "a_1.jpg", 5.5), ("y", "a_1_2.jpg", 601), ("z", "b", 602)]
    claims = [(d, n, i) for i, (d, n, _) in enumerate(sorted(claims, key=lambda c: c[2]))]
    df = spark.createDataFrame(claims, "d string, n string, o long")
    found = collisions.resolve(df, "d", "n", ["o"], "chained").withColumn("task", F.spark_partition_id()).collect()
    assert {r.o: r.final_name for r in found} == sequential(claims, [], "chained")
    tasks = Counter()
    for r in found:
        tasks[r.task] += len(r.final_name)
    assert sum(tasks.values()) > 660_000 and max(tasks.values()) < 150_000


def test_long_chains_are_small_on_disk(spark, tmp_path):
    """Chains of one base have quadratic length in all, but each is the one before and an index."""
    df = spark.range(4000).selectExpr("'x' as d", "'a.jpg' as n", "id as o").coalesce(1)
    collisions.resolve(df, "d", "n", ["o"], "chained").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names").agg(F.sum(F.length("final_name"))).first()[0]
    written = sum(f.stat().st_size for f in (tmp_path / "names").glob("*.parquet"))
    assert names > 35_000_000 and written < names / 50
