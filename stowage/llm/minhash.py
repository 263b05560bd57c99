"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

Texts with the same shingle set form one class.  Classes that share a band of their
signatures are candidates; their signatures are compared batch by batch, and a pair is dropped
once the posterior probability of reaching the threshold falls below ``miss``.  What
survives is verified on the full shingle sets.

A bucket may hold very many classes, so pairs are never listed bucket by bucket.  First every
class is compared with one centre of each of its buckets.  Buckets that still hold more than one
component are then dealt into cells of bounded size, none of which holds the largest component
alone.  A cell drops what has no candidate left by the signatures, verifies the others on their
full sets, the likeliest pairs first and none that is connected already, and gives a forest: fewer
rows than it has.  So every candidate pair is verified, dropped by its posterior, or connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import attach, by_batch, components, groups, marked, pick, texts
from stowage.operators.scratch import save

#: 32 bands of 4: a pair at 0.75 shares no band with a probability of 0.000005.
BANDS, ROWS = 32, 4
#: Values compared at a time.
STEP = 32
#: Chance to drop a pair that reaches the threshold.
MISS = 1e-6
#: Rows of a bucket that meet in one cell come from two chunks of about this many, ...
CELL = 1024
#: ... whose sets have about this many shingles together.
CELL_SHINGLES = 1 << 22

_CACHE_WORDS = 300_000
_BLOCK = 30_000
_SEED = 20240613

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Word to 64-bit hash; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z count as a-z; words are separated by ASCII white space.  With fewer than ``size``
    words the whole sequence is the one shingle; without words there is none.
    """
    words = text.translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _MIX + ids[i : n - width + 1 + i]
    h ^= h >> np.uint64(32)
    h *= _FINAL
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return (
        rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
        rng.integers(0, 2**63, count, dtype=np.uint64),
    )


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash signatures (uint32) of sets that are not empty."""
    factor, shift = _permutations(count)
    out = np.empty((len(sets), count), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) <= _BLOCK):
            held += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for k in range(count):
            mixed = values * factor[k]
            mixed += shift[k]
            mixed >>= np.uint64(32)
            out[at:end, k] = np.minimum.reduceat(mixed, starts)
        at = end
    return out


def _digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _profile(batch: pa.RecordBatch, size: int, count: int) -> pa.RecordBatch:
    sets = [shingle_set(t, size) for t in texts(batch.column(1))]
    full = [s for s in sets if len(s)]
    made = iter(signatures(full, count)) if full else iter(())
    return pa.record_batch(
        [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
            pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
            batch.column(2),
        ],
        ["doc_id", "n_shingles", "set_id", "sig", "text_hash"],
    )


def _posterior_floor(threshold: float, miss: float, steps: list[int]) -> list[int]:
    """For every number of compared values: the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    floors = []
    for n in steps:
        below, floor = 0.0, 0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            floor = m + 1
        floors.append(floor)
    return floors


def _survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float):
    """Indexes of the signature pairs that no batch has dropped, and their matches."""
    count = left.shape[1]
    steps = [min(s + STEP, count) for s in range(0, count, STEP)]
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for end, floor in zip(steps, _posterior_floor(threshold, miss, steps), strict=True):
        begin = end - STEP if end % STEP == 0 else end - end % STEP
        same = (left[alive, begin:end] == right[alive, begin:end]).sum(1, dtype=np.int32)
        matches = matches + same
        keep = matches >= floor
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _prune(batch: pa.RecordBatch, threshold: float, miss: float) -> pa.RecordBatch:
    """Rows (a, b, sig_a, sig_b) whose signatures leave a chance."""
    if not batch.num_rows:
        return batch.select(["a", "b"])
    alive, _ = _survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold, miss)
    return batch.select(["a", "b"]).take(pa.array(alive))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _at_least(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Rows (a, b, set_a, set_b) that are alike."""
    sets = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
    kept = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets]
    return batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _sets_of(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Rows (rid, set_id, text): the full sets of those whose text is that of the class."""
    rids, found = [], []
    columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))
    for rid, set_id, text in zip(*columns, strict=True):
        items = shingle_set(text, size)
        if len(items) and _digest(items) == set_id:
            rids.append(rid)
            found.append(items.tobytes())
    return pa.record_batch([pa.array(rids, pa.int64()), pa.array(found, pa.binary())], ["rid", "items"])


def _cell(sig, comp, chunk, band: int, threshold: float, miss: float, rows: int):
    """(matches, x, y) of the pairs of a cell that lie in two components and survive.

    A pair is looked at only in the first band in which it meets; with ``chunk``, only across chunks.
    """
    found = []
    for x in range(len(sig) - 1):
        others = np.arange(x + 1, len(sig))
        others = others[comp[others] != comp[x]]
        if chunk is not None:
            others = others[chunk[others] != chunk[x]]
        if band and len(others):
            same = sig[others, : band * rows] == sig[x, : band * rows]
            others = others[~same.reshape(len(others), band, rows).all(2).any(1)]
        if len(others):
            left = np.broadcast_to(sig[x], (len(others), sig.shape[1]))
            alive, matches = _survivors(left, sig[others], threshold, miss)
            found += [(int(m), x, int(y)) for m, y in zip(matches, others[alive], strict=True)]
    return found


_IN_CELL = "band int, bucket long, _i int, _j int, _own int, rid long, comp long, sig binary"


def _in_cells(batches, threshold: float, miss: float, rows: int):
    """Cells in rows sorted by cell: (table, start, survivors) of each that has survivors."""
    for table, bounds in groups(batches, ["bucket", "_i", "_j"]):
        bands, own = (table[c].to_numpy() for c in ("band", "_own"))
        comps = table["comp"].to_numpy()
        across = table["_i"].to_numpy() != table["_j"].to_numpy()
        sigs = _matrix(table["sig"])
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            part = slice(start, end)
            chunk = own[part] if across[start] else None
            found = _cell(sigs[part], comps[part], chunk, int(bands[start]), threshold, miss, rows)
            if found:
                yield table, start, found


def _wanted(batches, *how):
    """The rows of every cell that have a survivor in it."""
    for table, start, found in _in_cells(batches, *how):
        rows = np.unique(np.array(found)[:, 1:]) + start
        yield from table.take(pa.array(rows)).to_batches()


def _united(batches, percent: int, *how):
    """Rows (a, b): what joins the components of a cell, verified on the sets of its rows."""
    for table, start, found in _in_cells(batches, *how):
        comps, rids = table["comp"].to_numpy(), table["rid"].to_numpy()
        parent = {int(c): int(c) for c in comps}
        sets: dict[int, np.ndarray] = {}

        def root(at: int) -> int:
            c = int(comps[at])
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def items(at: int) -> np.ndarray:
            if at not in sets:
                sets[at] = np.frombuffer(table["items"][at].as_py(), np.uint64)
            return sets[at]

        a, b = [], []
        for _, x, y in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            x, y = x + int(start), y + int(start)
            one, two = root(x), root(y)
            if one != two and _alike(items(x), items(y), percent):
                parent[one] = two
                a.append(rids[x])
                b.append(rids[y])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _dealt(placed: DataFrame, limit: int) -> DataFrame:
    """Rows (band, bucket, rid, comp, n_shingles) of buckets with several components, in cells.

    The rows of the largest component and the others are cut into chunks of about ``limit`` rows.  A cell
    holds a chunk of each (``_j`` < 0), or two chunks of the others; ``_own`` tells the row's side.  What fits into
    one cell is one.
    """
    keys = ["band", "bucket"]
    size = F.greatest(F.lit(1.0) / limit * F.count("*"), F.sum("n_shingles") / F.lit(float(CELL_SHINGLES)))
    parts = placed.groupBy(*keys, "comp").agg(size.alias("size"))
    open_ = parts.groupBy(*keys).agg(
        F.count("*").alias("comps"),
        F.sum("size").alias("all"),
        F.max("size").alias("most"),
        F.max_by("comp", F.struct("size", "comp")).alias("main"),
    )
    rest = F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("most"))).cast("int")
    open_ = save(
        open_.filter("comps > 1").select(
            *keys, "main", "all", F.ceil("most").cast("int").alias("mains"), rest.alias("rests")
        ),
        "open",
    )
    rows = placed.join(open_, keys).drop("n_shingles")
    is_main, single = F.col("comp") == F.col("main"), F.col("all") <= 1
    chunk = F.pmod(F.xxhash64("rid"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("chunk", chunk)

    def cell(i, j, own):
        return F.struct(i.alias("_i"), j.alias("_j"), own.alias("_own"))

    def numbers(n):
        return F.sequence(F.lit(0), F.col(n) - 1)

    at, zero = F.col("chunk"), F.lit(0)
    with_rest = F.transform(numbers("rests"), lambda j: cell(at, -1 - j, F.lit(0)))
    with_main = F.transform(numbers("mains"), lambda i: cell(i, -1 - at, F.lit(1)))
    among = F.transform(numbers("rests"), lambda j: cell(F.least(at, j), F.greatest(at, j), at))
    where = F.when(single, F.array(cell(zero, zero, zero))).when(is_main, with_rest)
    rows = rows.withColumn("cell", F.explode(where.otherwise(F.concat(with_main, among))))
    return rows.select(*keys, "cell.*", "rid", "comp")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    cell: int = CELL,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept, text_hash, group_id.

    Documents are linked if 100 * |A n B| >= percent * |A u B| for their sets of ``size``-word
    shingles.  component_id is the smallest key that links reach, kept tells whether it is the
    document's own.  Empty and null texts are linked with nothing.  A repeated row comes back as
    often as it occurs.  Texts that share a key are linked each by itself: ``text_hash`` (xxhash64) tells them apart, and
    ``group_id`` (null without words or key) is one for what is linked.  A row without a key links
    with nothing, has no component and is not kept.  Texts may have any length; an empty
    table gives no rows; other columns are not looked at.
    """
    docs = pick(docs, key, text).toDF("doc_id", "text")
    threshold, count = percent / 100, bands * rows
    schema = "doc_id long, n_shingles long, set_id binary, sig binary, text_hash long"
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    known = save(
        docs.mapInArrow(by_batch(_profile, size, count), schema).withColumn(
            "rid", F.monotonically_increasing_id()
        ),
        "signatures",
    )
    usable = known.filter("set_id is not null and doc_id is not null")
    classes = save(
        usable.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("rid").alias("rid")),
        "classes",
    )

    # classes that share a band with another class
    keys = [
        F.struct(
            F.lit(b).alias("band"),
            F.xxhash64(F.lit(b), F.substring("sig", b * rows * 4 + 1, rows * 4)).alias("bucket"),
        )
        for b in range(bands)
    ]
    lone = known.select("rid", "sig", "n_shingles").join(classes.select("rid"), "rid")
    dealt = lone.select("rid", "n_shingles", F.explode(F.array(*keys)).alias("k"))
    dealt = dealt.select("rid", "n_shingles", "k.*")
    buckets = (
        dealt.groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.min("rid").alias("centre"))
        .filter("n > 1")
        .drop("n")
    )
    members = save(dealt.join(buckets, ["band", "bucket"]), "members")
    involved = members.select("rid").distinct()
    wanted = save(
        lone.join(involved, "rid").join(classes, "rid").select("rid", "set_id", "id", "sig"),
        "wanted",
    )
    # a bit for every id that is needed keeps most other texts from being shuffled
    needed = marked(wanted.select(F.xxhash64("id").alias("hash")))
    sets = docs.filter(needed("xxhash64(doc_id)"))
    sets = sets.join(wanted.select("id", "rid", "set_id"), F.col("doc_id") == F.col("id"))
    sets = sets.select("rid", "set_id", "text").mapInArrow(
        by_batch(_sets_of, size), "rid long, items binary"
    )
    sets = save(sets.groupBy("rid").agg(F.first("items").alias("items")), "sets")
    sigs = wanted.select("rid", "sig")

    def verify(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.toDF(side, f"set_{side}"), side)
        pairs = pairs.select("a", "b", "set_a", "set_b")
        return pairs.mapInArrow(by_batch(_at_least, percent), "a long, b long")

    pairs = members.filter("rid <> centre").select(F.col("centre").alias("a"), F.col("rid").alias("b"))
    pairs = pairs.distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sigs.toDF(side, f"sig_{side}"), side)
    pairs = pairs.select("a", "b", "sig_a", "sig_b")
    pairs = pairs.mapInArrow(by_batch(_prune, threshold, miss), "a long, b long")
    roots = save(components(verify(pairs)), "roots")

    placed = members.select("band", "bucket", "rid", "n_shingles").join(roots.toDF("rid", "root"), "rid", "left")
    placed = placed.withColumn("comp", F.coalesce("root", "rid")).drop("root")
    names = [c.split()[0] for c in _IN_CELL.split(", ")]
    how = threshold, miss, rows

    def in_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j")

    dealt = in_cells(_dealt(placed, cell).join(sigs, "rid").select(*names))
    left = save(dealt.mapInArrow(lambda batches: _wanted(batches, *how), _IN_CELL), "left")
    links = in_cells(left.join(sets, "rid").select(*names, "items"))
    links = links.mapInArrow(lambda batches: _united(batches, percent, *how), "a long, b long")
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = save(components(stars.union(links)), "roots")

    comps = classes.join(roots.toDF("rid", "root"), "rid", "left")
    comps = comps.withColumn("comp", F.coalesce("root", "rid")).select("set_id", "id", "comp")
    names = comps.groupBy("comp").agg(F.min("id").alias("component"))
    comps = attach(comps, names, "comp", ["set_id"]).select("set_id", "component", "comp")
    out = attach(known.drop("sig"), comps, "set_id", ["rid"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        F.col("doc_id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
        "text_hash",
        F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("group_id"),
    )
