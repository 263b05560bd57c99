import random

import pytest

from stowage.functions.sizes import limit_bytes
from stowage.operators import packing

MIB = 1024**2


def sequential(files, limit):
    """The rule, one file after the other: path -> batch from 1."""
    placed, batch, used = {}, 0, None
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if size > limit:
            batch, used = batch + 1, None
        elif used is None or used + size > limit:
            batch, used = batch + 1, size
        else:
            used += size
        placed[path] = batch
    return placed


def frame(spark, files):
    return spark.createDataFrame(files, "path string, size long")


def packed(spark, files, limit, **options):
    rows = packing.pack(frame(spark, files), limit, **options).collect()
    return {r.path: r.batch for r in rows}


@pytest.mark.parametrize(
    "sizes, gb, batches",
    [
        ([3, 4, 2], 0.01, [[4, 3, 2]]),
        ([8, 6, 5], 0.01, [[8], [6], [5]]),
        ([15, 2], 0.01, [[15], [2]]),
        ([8, 7, 4, 3, 1, 1], 0.01, [[8], [7], [4, 3, 1, 1]]),
        (
            [800, 600, 500, 1200, 300, 200, 400, 350, 50, 45, 55],
            1.0,
            [[1200], [800], [600], [500, 400], [350, 300, 200, 55, 50, 45]],
        ),
    ],
)
def test_known_batches(spark, sizes, gb, batches):
    files = [(f"f{i:02d}", s * MIB) for i, s in enumerate(sizes)]
    found = packed(spark, files, limit_bytes(gb))
    by_batch = {}
    for path, batch in found.items():
        by_batch.setdefault(batch, []).append(dict(files)[path] // MIB)
    assert [sorted(by_batch[b], reverse=True) for b in sorted(by_batch)] == batches


def test_limit_drops_fractions_of_a_byte():
    assert limit_bytes(0.01) == 10_737_418


def test_full_batch_is_allowed(spark):
    assert packed(spark, [("a", 6), ("b", 4), ("c", 1)], 10) == {"a": 1, "b": 1, "c": 2}


def test_empty_files_are_left_out(spark):
    assert packed(spark, [("a", 0), ("b", 4)], 10) == {"b": 1}
    assert packing.batch_count(frame(spark, [("a", 0)]), 10) == 0


def cases():
    rng = random.Random(7)
    for _ in range(400):
        limit = rng.choice([1, 2, 7, 30, 100, 1000])
        top = rng.choice([2, limit, limit * 2 + 1])
        n = rng.randint(1, 40)
        yield limit, [(f"p{i}", rng.randint(1, max(1, top))) for i in range(n)]


def test_fold_equals_the_sequential_rule():
    """The fold alone, on the reduced histogram, over many small cases."""
    from itertools import groupby

    for limit, files in cases():
        expected = sequential(files, limit)
        order = sorted(files, key=lambda f: (-f[1], f[0]))
        fold, found = packing._Fold(limit), {}
        for k, group in groupby(order, key=lambda f: limit // f[1]):
            group = list(group)
            total = len(group)
            edge, seen = [], 0
            for size, same in groupby(group, key=lambda f: f[1]):
                n = len(list(same))
                if k == 0 or seen < k or total - seen - n < k:
                    edge.append((size, n))
                seen += n
            _, _, fill, opened, following, _ = fold.add(k, total, edge)
            for i, (path, _) in enumerate(group):
                found[path] = opened if i < fill else following + (i - fill) // max(k, 1)
        assert found == expected, (limit, files)


def test_a_range_of_classes_does_what_its_classes_do():
    """Functions of ranges, composed, against the fold, from every state of the open batch."""
    rng = random.Random(13)
    for limit, files in cases():
        by_class = {}
        for size in sorted((s for _, s in files if s <= limit), reverse=True):
            by_class.setdefault(limit // size, []).append(size)
        classes = [(k, len(s), [(z, s.count(z)) for z in dict.fromkeys(s)]) for k, s in by_class.items()]
        cut = rng.randint(0, len(classes))
        parts = [packing._Steps(limit), packing._Steps(limit)]
        for i, (k, total, edge) in enumerate(classes):
            parts[i >= cut].add(k, total, edge)
        for open_bytes in range(limit + 1):
            fold = packing._Fold(limit, 3, open_bytes)
            for k, total, edge in classes:
                fold.add(k, total, edge)
            assert parts[1].after(*parts[0].after(3, open_bytes)) == (fold.batch, fold.open_bytes)


def test_a_limit_of_a_tebibyte(spark):
    rng = random.Random(17)
    limit = 1 << 40
    sizes = [int(limit * rng.random() ** 6) + 1 for _ in range(1500)] + [limit // 3] * 40 + [7] * 300
    files = [(f"p{i}", s) for i, s in enumerate(sizes)]
    assert packed(spark, files, limit, group_rows=100) == sequential(files, limit)


@pytest.mark.parametrize("group_rows", [None, 3])
def test_pack_equals_the_sequential_rule(spark, group_rows):
    rng = random.Random(11)
    for limit, n in [(1000, 300), (64, 500)]:
        files = [(f"p{i}", rng.choice([1, 2, 3, rng.randint(1, limit + 20)])) for i in range(n)]
        expected = sequential(files, limit)
        assert packed(spark, files, limit, group_rows=group_rows) == expected
        assert packing.batch_count(frame(spark, files), limit) == max(expected.values())


@pytest.mark.parametrize("group_rows", [None, 5])
def test_pack_per_group(spark, group_rows):
    rng = random.Random(3)
    rows = [(f"d{rng.randint(0, 3)}", f"p{i}", rng.randint(1, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "dir string, path string, size long")
    found = {r.path: r.batch for r in packing.pack(df, 60, ["dir"], group_rows=group_rows).collect()}
    for d in {r[0] for r in rows}:
        expected = sequential([(p, s) for g, p, s in rows if g == d], 60)
        assert {p: found[p] for p in expected} == expected


def test_totals_stay_below_the_limit(spark):
    rng = random.Random(5)
    files = [(f"p{i}", rng.randint(1, 130)) for i in range(400)]
    rows = packing.batch_totals(packing.pack(frame(spark, files), 100)).collect()
    assert sum(r.files for r in rows) == 400
    assert all(r.bytes <= 100 or r.files == 1 for r in rows)
    assert {r.directory for r in rows} == {f"batch_{r.batch:03d}" for r in rows}
