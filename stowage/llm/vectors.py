"""Near-duplicate vectors: p-stable hashing into several tables, exact cosine in the buckets.

A table hashes a unit vector by ``k`` random projections, each shifted and cut into steps of
``width``.  Vectors that share a bucket meet in cells of bounded size, where their cosines
are computed in double precision; a pair counts only in the first table that brings it together.
A cell gives the number of links of its vectors and a spanning forest of the links, never all
pairs, so groups of copies may have any size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import attach, by_batch, cells, components, groups, pick
from stowage.operators.scratch import save

#: Steps of the quantised projections, for unit vectors.
WIDTH = 2.0
#: Chance that a pair right at the threshold shares no bucket.
MISS = 0.01
#: Unrelated vectors that a bucket may hold on average.
CROWD = 0.5
#: Rows of a bucket that meet in one cell come from two chunks of this many.
CELL = 1024

_SEED = 7919


def _collide(distance: float, width: float) -> float:
    """Chance that one quantised projection puts two points at a distance into one step."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2)) / 2
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(rows: int, cosine: float, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Projections a table and number of tables.

    As many projections as make buckets hold about CROWD of ``rows`` unrelated (orthogonal)
    vectors, then as many tables as leave a chance of ``miss`` at the threshold.
    """
    near = _collide(math.sqrt(2 - 2 * cosine), width)
    far = _collide(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(rows, 2) / CROWD) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def _units(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(vec_id, vec): unit vectors as bytes; null where a vector links with nothing."""
    out = []
    for v in batch.column(1).to_pylist():
        unit = None
        if v and None not in v:
            x = np.array(v, np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                largest = np.abs(x).max()
                if np.isfinite(largest) and largest > 0:
                    x = x / largest
                    unit = (x / np.sqrt((x * x).sum())).tobytes()
        out.append(unit)
    return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


@lru_cache(maxsize=4)
def _projections(dim: int, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED + dim)
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def _hash(vectors: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit bucket for each vector and table."""
    axes, shift = _projections(vectors.shape[1], k, tables, width)
    steps = np.floor((vectors @ axes + shift) / width).astype(np.int64).astype(np.uint64)
    steps = steps.reshape(len(vectors), tables, k)
    out = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(vectors.shape[1] << 20), steps.shape[:2])
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, i]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _buckets(batches, k: int, tables: int, width: float):
    """(rid, t, bucket) for every table t; about a thousand vectors at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            raw = part.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_size.setdefault(len(v), []).append(i)
            for at in by_size.values():
                vectors = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                found = _hash(vectors, k, tables, width)
                rid = part.column(0).to_numpy()[at]
                number = np.tile(np.arange(tables, dtype=np.int32), len(at))
                buckets = np.ascontiguousarray(found).ravel()
                yield pa.record_batch(
                    [pa.array(np.repeat(rid, tables)), pa.array(number), pa.array(buckets)],
                    ["rid", "t", "bucket"],
                )


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indexes of links that connect as much as all of them do."""
    parent = list(range(n))
    out = []
    for at, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            out.append(at)
    return out


def _cell(vectors, chunk, t: int, cosine: float, k: int, tables: int, width: float):
    """Pairs of a cell that reach the threshold and share no earlier table."""
    lefts, rights = [], []
    for start in range(0, len(vectors), 256):
        x, y = np.nonzero(vectors[start : start + 256] @ vectors.T >= cosine)
        x = x + start
        keep = x < y
        if chunk is not None:
            keep &= chunk[x] != chunk[y]
        lefts.append(x[keep])
        rights.append(y[keep])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if len(left) and t:
        keys = _hash(vectors, k, tables, width)
        first = np.ones(len(left), bool)
        for start in range(0, len(left), 65536):
            part = slice(start, start + 65536)
            first[part] = ~(keys[left[part], :t] == keys[right[part], :t]).any(1)
        left, right = left[first], right[first]
    return left, right


def _meet(batches, cosine: float, k: int, tables: int, width: float):
    """Rows (a, b, n): a link of the forest, or with b null the links n that a has in a cell."""
    for table, bounds in groups(batches, ["bucket", "_i", "_j"]):
        own, rid, weight, t = (table[c].to_numpy() for c in ("_own", "rid", "copies", "t"))
        across = table["_i"].to_numpy() != table["_j"].to_numpy()
        raw = table["vec"].to_pylist()
        sizes = np.array([len(v) for v in raw])
        found = np.zeros(len(rid), np.int64)
        a, b = [], []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            # vectors of different lengths meet by chance only, and never link
            for size in np.unique(sizes[start:end]):
                rows = start + np.flatnonzero(sizes[start:end] == size)
                vectors = np.frombuffer(b"".join([raw[r] for r in rows])).reshape(len(rows), -1)
                if len(rows) < 2 or (len(rows) == 2 and vectors[0] @ vectors[1] < cosine):
                    continue
                chunk = own[rows] if across[start] else None
                left, right = _cell(vectors, chunk, int(t[start]), cosine, k, tables, width)
                np.add.at(found, rows[left], weight[rows[right]])
                np.add.at(found, rows[right], weight[rows[left]])
                for at in _forest(len(rows), left, right):
                    a.append(rid[rows[left[at]]])
                    b.append(rid[rows[right[at]]])
        some = np.flatnonzero(found)
        yield pa.record_batch(
            [
                pa.array(rid[some].tolist() + a, pa.int64()),
                pa.array([None] * len(some) + b, pa.int64()),
                pa.array(found[some].tolist() + [0] * len(a), pa.int64()),
            ],
            ["a", "b", "n"],
        )


def near_duplicates(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.9,
    width: float = WIDTH,
    miss: float = MISS,
    cell: int = CELL,
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``cosine`` that share a bucket of some table; a
    pair right at the threshold is missed with probability ``miss``, closer ones far less often.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with one another.  Equal vectors form one class,
    so copies are counted and not compared.  A repeated row comes back as often as it occurs and
    counts as a vector of its own.  A row without a key links with nothing, has no
    component and is not kept.  An empty table gives no rows; other columns are not looked at.
    """
    table = pick(table, key, vector).toDF("vec_id", "vec")
    table = table.withColumn("vec_id", F.col("vec_id").cast("long"))
    table = table.withColumn("vec", F.col("vec").cast("array<double>"))
    known = save(
        table.mapInArrow(by_batch(_units), "vec_id long, vec binary")
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumn("same", F.when(F.col("vec_id").isNotNull(), F.md5("vec"))),
        "units",
    )
    classes = save(
        known.filter("same is not null")
        .groupBy("same")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("id"), F.min("rid").alias("rid")),
        "classes",
    )
    k, tables = plan_tables(classes.count(), cosine, width, miss)
    unit = save(known.select("rid", "vec").join(classes.select("rid", "copies"), "rid"), "unit")

    def place(batches):
        return _buckets(batches, k, tables, width)

    dealt = save(unit.select("rid", "vec").mapInArrow(place, "rid long, t int, bucket long"), "buckets")
    crowded = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = cells(dealt.join(crowded, "bucket"), F.col("n"), cell, "rid").drop("n")
    dealt = dealt.join(unit, "rid").select(
        "t", "bucket", "_i", "_j", "_own", "rid", "copies", "vec"
    )
    dealt = dealt.repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j")

    def meet(batches):
        return _meet(batches, cosine, k, tables, width)

    found = save(dealt.mapInArrow(meet, "a long, b long, n long"), "links")
    roots = save(components(found.filter("b is not null").select("a", "b")), "roots")
    links = found.filter("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    comps = classes.join(roots.toDF("rid", "root"), "rid", "left").join(links, "rid", "left")
    comps = comps.withColumn("comp", F.coalesce("root", "rid"))
    names = comps.groupBy("comp").agg(F.min("id").alias("component"))
    comps = attach(comps, names, "comp", ["rid"])
    linked = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    out = attach(known.drop("vec"), comps.select("same", "component", linked), "same", ["rid"])
    component = F.coalesce("component", "vec_id")
    return out.select(
        F.col("vec_id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
