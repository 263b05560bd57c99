"""Clustering around centroids in whole numbers, filtered by a PCA rotation.

Vectors are rotated so that their leading coordinates hold most of their variance.  Each keeps those and the
length of the rest.  The distance of two vectors is at least that of their leading coordinates plus the squared
difference of their rests, so most centroids are ruled out without reading the vector; those that are left
are compared in whole numbers.  The rotation is fitted to ``FIT_ROWS`` vectors and decides how many comparisons
are left over, never the outcome.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import pick
from stowage.operators.scratch import save

#: Vectors that the rotation is fitted to: those with the smallest hash of their id.
FIT_ROWS = 2048
#: Leading coordinates that are kept.
LEADING = 16
#: Share of the squared norms that float errors of a bound stay far below.
SLACK = 1e-9

_SAFE = 1 << 26  # 64 squares of differences of such numbers stay below 2 ** 63
_LIMB = 32


@dataclass
class Rotation:
    """Centre and an orthonormal basis, the directions of most variance first."""

    centre: np.ndarray
    basis: np.ndarray

    def apply(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the length of the rest."""
        with np.errstate(over="ignore", invalid="ignore"):
            turned = (rows - self.centre) @ self.basis
            return turned[:, :LEADING], np.sqrt((turned[:, LEADING:] ** 2).sum(axis=1))


def fit(rows: np.ndarray) -> Rotation:
    centre = rows.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        moved = rows - centre
        spread = moved.T @ moved
    if not np.isfinite(spread).all():  # numbers beyond the range of squares: any basis will do
        return Rotation(np.zeros(rows.shape[1]), np.eye(rows.shape[1]))
    return Rotation(centre, np.linalg.eigh(spread)[1][:, ::-1])


def whole_vectors(table: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, whole): floor(scale * x) of vectors of ``size`` components, as doubles that hold whole numbers.

    Vectors that are null, of another length, or have a component that is null or not finite (before or after
    it is scaled) are left out.
    """
    rows = pick(table, "vec_id", "embedding")
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    rows = rows.filter(F.size("embedding") == size).select("vec_id", scaled.alias("scaled"))
    finite = F.forall("scaled", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    # 0.5 less than a whole number has its floor; below 2 ** 52 doubles have halves, above they are whole
    floor = F.transform(
        "scaled", lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    )
    return rows.filter(F.coalesce(finite, F.lit(False))).select("vec_id", floor.alias("whole"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rotate(rotation: Rotation):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leading, rest = rotation.apply(_matrix(batch.column("whole")))
            leading = pa.FixedSizeListArray.from_arrays(pa.array(leading.reshape(-1)), leading.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("whole"), leading.cast(pa.list_(pa.float64())), pa.array(rest)],
                ["vec_id", "whole", "leading", "rest"],
            )

    return run


def _exact(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared distances in whole numbers: int64, or Python's where those could overflow."""
    if max(map(abs, centroid), default=0) < _SAFE and (np.abs(rows) < _SAFE).all():
        apart = rows.astype(np.int64) - np.array(centroid, dtype=np.int64)
        return np.einsum("ij,ij->i", apart, apart)
    out = np.empty(len(rows), dtype=object)
    for i, row in enumerate(rows):
        out[i] = sum((int(x) - c) ** 2 for x, c in zip(row, centroid))
    return out


def _floats(distances: np.ndarray) -> np.ndarray:
    if distances.dtype == np.int64:
        return distances.astype(float)
    return np.array([float(d) if d < 1 << 1000 else np.inf for d in distances])


def assign(
    rows: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: list[list[int]], rotation: Rotation
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row (ties: the first) and its squared distance."""
    as_floats = np.array([[float(x) for x in c] for c in centroids])
    near, far = rotation.apply(as_floats)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.empty((len(rows), len(centroids)))
        for j in range(len(centroids)):
            bounds[:, j] = ((leading - near[j]) ** 2).sum(axis=1) + (rest - far[j]) ** 2
        norms = (leading**2).sum(axis=1) + rest**2
        bounds -= SLACK * (norms[:, None] + (near**2).sum(axis=1) + far**2)
    nearest = np.argmin(bounds, axis=1)
    best = np.empty(len(rows), dtype=object)
    for j in np.unique(nearest):
        mine = np.flatnonzero(nearest == j)
        best[mine] = _exact(rows[mine], centroids[j])
    if len(rows) and max(best) < 1 << 63:
        best = best.astype(np.int64)
    guessed, reach = nearest.copy(), _floats(best)
    for j, centroid in enumerate(centroids):
        # not above: what can't be compared is checked as well
        left = np.flatnonzero(~(bounds[:, j] > reach) & (guessed != j))
        if not len(left):
            continue
        found = _exact(rows[left], centroid)
        closer = (found < best[left]) | ((found == best[left]) & (j < nearest[left]))
        moved = left[closer.astype(bool)]
        if found.dtype == object:
            best = best.astype(object)
        best[moved], nearest[moved] = found[closer.astype(bool)], j
    return nearest, best


def _batch_assign(batch: pa.RecordBatch, centroids, rotation):
    rows, leading = _matrix(batch.column("whole")), _matrix(batch.column("leading"))
    return rows, *assign(rows, leading, batch.column("rest").to_numpy(), centroids, rotation)


_SUMS = "cluster int, limb int, sums array<long>"


def _partial_sums(centroids: list[list[int]], rotation: Rotation):
    """For mapInArrow: a task's sums and counts by cluster, in limbs that can be added as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centroids[0])
        sums: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, nearest, _ = _batch_assign(batch, centroids, rotation)
            for j in np.unique(nearest):
                mine = rows[nearest == j]
                held = sums.setdefault(int(j), [0] * (width + 1))
                if (np.abs(mine) < _SAFE).all():
                    added = mine.astype(np.int64).sum(axis=0).tolist()
                else:
                    added = [sum(map(int, column)) for column in mine.T]
                for i, value in enumerate([*added, len(mine)]):
                    held[i] += value
        out = []
        for j, values in sums.items():
            limb = 0
            while True:
                last = all(-(1 << 62) <= v < 1 << 62 for v in values) and limb > 0
                low = [v if last else v & ((1 << _LIMB) - 1) for v in values]
                out.append((j, limb, low))
                if last:
                    break
                values, limb = [v >> _LIMB for v in values], limb + 1
        if out:
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "limb", "sums"])

    return run


def _moved(table: DataFrame, centroids: list[list[int]], rotation: Rotation) -> list[list[int]]:
    """Centroids after one round; one row per cluster, limb and component reaches the driver."""
    partial = table.mapInArrow(_partial_sums(centroids, rotation), _SUMS)
    parts = partial.select("cluster", "limb", F.posexplode("sums").alias("at", "value"))
    value = F.sum(F.col("value").cast("decimal(38,0)"))
    sums: dict[int, list[int]] = {}
    for row in parts.groupBy("cluster", "limb", "at").agg(value.alias("value")).collect():
        held = sums.setdefault(row.cluster, [0] * (len(centroids[0]) + 1))
        held[row.at] += int(row.value) << (_LIMB * row.limb)
    return [
        [s // sums[j][-1] for s in sums[j][:-1]] if j in sums else centroid
        for j, centroid in enumerate(centroids)
    ]


_ASSIGNED = "vec_id long, cluster int, distance long"


def _assigned(centroids: list[list[int]], rotation: Rotation):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, nearest, best = _batch_assign(batch, centroids, rotation)
            fits = [int(d) if d < 1 << 63 else None for d in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(fits, pa.int64())],
                ["vec_id", "cluster", "distance"],
            )

    return run


def cluster(
    table: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:vec_id`` (equal ids: by their
    components; a null id counts as no digits); with fewer vectors there are fewer centroids.  Each of ``rounds``
    rounds moves them to the floor of their vectors' mean.  All comparisons are exact, ties go to the
    smaller number.  Vectors that are null, of another length, or hold nulls or non-finite components are
    left out, repeated rows count each, an empty table gives none, further columns are left out.  A distance
    or sum beyond 64 bits is null.
    """
    spark = table.sparkSession
    whole = save(whole_vectors(table, size, scale), "whole")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.orderBy(digest, "vec_id", "whole").limit(max(FIT_ROWS, k)).select("whole").collect()
    schema = f"{_ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    rotation = fit(np.array([r.whole for r in first]))
    centroids = [[int(x) for x in r.whole] for r in first[:k]]
    rotated = whole.mapInArrow(
        _rotate(rotation), "vec_id long, whole array<double>, leading array<double>, rest double"
    )
    rotated = save(rotated, "rotated")
    for _ in range(rounds):
        centroids = _moved(rotated, centroids, rotation)

    found = save(rotated.mapInArrow(_assigned(centroids, rotation), _ASSIGNED), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    all_fit = F.count("distance") == F.count("*")
    sums = found.groupBy("cluster").agg(F.when(all_fit, total).alias("s")).collect()
    inertia = {r.cluster: None if r.s is None else int(r.s) for r in sums}

    def fitting(value: int | None) -> int | None:
        return value if value is not None and value < 1 << 63 else None

    everything = None if None in inertia.values() else sum(inertia.values())
    facts = [
        (j, fitting(s), fitting(everything), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for j, s in inertia.items()
    ]
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = F.broadcast(spark.createDataFrame(facts, fields))  # k rows
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
