"""Clustering in whole numbers against the plain algorithm, with numbers of any size."""

import hashlib
import math
from fractions import Fraction

import numpy as np

from stowage.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k=8, rounds=10, size=64):
    whole = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x * 1024) for x in v):
            whole.append((i, [math.floor(Fraction(x) * 1024) for x in v]))

    def digest(i):
        return hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(found))

    found = [v for _, v in sorted(whole, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        members = [[] for _ in found]
        for _, v in whole:
            members[nearest(v)[1]].append(v)
        found = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(found, members)]
    at = [(i, *nearest(v)) for i, v in whole]
    total = {j: sum(d for _, d, c in at if c == j) for j in range(k)}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]

    def fits(n):
        return n if n < 1 << 63 else None

    whole_sum = fits(sum(total.values()))
    return sorted([(i, j, fits(d), fits(total[j]), whole_sum, shas[j]) for i, d, j in at], key=repr)


def compare(spark, rows):
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in centroids.cluster(table).collect()]
    assert sorted(found, key=repr) == brute(rows)


def vectors(n, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 64))
    return [(i, (middles[i % 6] + rng.normal(size=64) * 0.4).tolist()) for i in range(n)]


def test_clusters_like_brute_force(spark):
    rows = vectors(150)
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(5, rows[5][1])] * 3
    nan, inf = float("nan"), float("inf")
    rows += [(300, None), (301, []), (302, [0.0] * 64), (303, [nan] + [0.0] * 63), (304, [None] + [0.0] * 63)]
    rows += [(305, [inf] + [0.0] * 63), (306, [1.0] * 65), (307, [-0.0] * 64), (None, rows[1][1])]
    compare(spark, rows)


def test_clusters_of_very_large_and_tied_numbers(spark):
    rows = vectors(40) + [(100, [1e30] * 64), (101, [-3e200] + [0.0] * 63), (102, [1e308] * 64)]
    rows += [(103, [float(1 << 45)] * 64), (104, [float(1 << 45)] * 63 + [float((1 << 45) + 1)])]
    compare(spark, rows)
    ties = [(i, [float(i % 3 - 1)] + [0.0] * 63) for i in range(30)]
    compare(spark, ties)


def test_fewer_vectors_than_centroids_and_none(spark):
    compare(spark, vectors(3))
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_rule_out_most_centroids():
    rows = np.floor(1024 * np.array([v for _, v in vectors(600)]))
    rotation = centroids.fit(rows)
    leading, rest = rotation.apply(rows)
    exact = ((rows[:, None] - rows[None, :8]) ** 2).sum(axis=2)
    bounds = ((leading[:, None] - leading[None, :8]) ** 2).sum(axis=2) + (rest[:, None] - rest[None, :8]) ** 2
    assert (bounds <= exact * (1 + 1e-9) + 1e-3).all()
    assert (bounds > exact.min(axis=1)[:, None]).mean() > 0.5
