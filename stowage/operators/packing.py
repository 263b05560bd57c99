"""Size-limited batches: next-fit over files in descending size.

A file above the limit stands alone.  Otherwise a file joins the open batch if it fits
and else closes it and opens the next.  The outcome looks sequential, but sizes of one
*class* k = limit div size behave alike: k of them always fit, k + 1 never do.  So

* the open batch takes up to k files from the head of a class,
* the rest of the class falls into batches of exactly k,
* the last of these, made of files from the tail of the class, stays open.

A file's batch follows from its position inside its class.  The fold over classes needs
the class counts and, per class, the k largest and the k smallest files: at most
2 * sqrt(limit) classes and about 3 * limit^(2/3) sizes, however many files there are.

Neither step runs in one task.  The histogram (size, files) is cut into ranges whose sums give every
size its position in its class.  The fold is cut into ranges of classes: what a range does to the
open batch is a function with few steps, as only the number of files that still fit matters, and
functions of consecutive ranges compose (see ``scan``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions import names
from stowage.operators.scan import Rule, scan
from stowage.operators.scratch import counted, save
from stowage.operators.skew import attach, number_rows

_CLASS_TABLE = [
    T.StructField("class_n", T.LongType()),
    T.StructField("fill", T.LongType()),
    T.StructField("open_batch", T.LongType()),
    T.StructField("next_batch", T.LongType()),
    T.StructField("last_batch", T.LongType()),
]


class _Fold:
    """State carried from class to class: batches used and bytes in the open one."""

    def __init__(self, limit: int, batch: int = 0, open_bytes: int | None = None):
        self.limit, self.batch, self.open_bytes = limit, batch, open_bytes

    def add(self, k: int, total: int, edge: list[tuple[int, int]]) -> tuple[int, ...]:
        """``edge`` holds (size, count), largest first, of the class's head and tail."""
        if k == 0:  # above the limit: one batch each
            row = (k, total, 0, 0, self.batch + 1, self.batch + total)
            self.batch, self.open_bytes = self.batch + total, None
            return row
        fill = 0
        if self.open_bytes is not None:
            for size, count in edge:
                fits = min(count, k - fill, (self.limit - self.open_bytes) // size)
                fill += fits
                self.open_bytes += fits * size
                if fits < count:
                    break
        open_batch, rest = self.batch, total - fill
        if rest:
            full = (rest - 1) // k  # closed batches of k; the one after them stays open
            left = rest - full * k
            self.batch += full + 1
            self.open_bytes = 0
            for size, count in reversed(edge):
                taken = min(count, left)
                self.open_bytes += taken * size
                left -= taken
                if not left:
                    break
        return (k, total, fill, open_batch, open_batch + 1, self.batch)


class _Steps:
    """What consecutive classes do to an open batch of any number of bytes.

    Up to ``upto[i]`` bytes, piece i adds ``batches[i]`` and leaves ``bytes[i]`` in the open batch; the first piece, while
    there is ``moved``, adds that to the bytes instead, as all files still fit.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.moved: int | None = 0
        self.upto, self.batches, self.bytes = (np.array([v], dtype=np.int64) for v in (limit, 0, 0))

    def add(self, k: int, total: int, edge: list[tuple[int, int]]) -> None:
        sizes = np.array([e[0] for e in edge], dtype=np.int64)
        counts = np.array([e[1] for e in edge], dtype=np.int64)
        most = min(k, total)
        upto_n = np.cumsum(counts)
        runs = int(np.searchsorted(upto_n, most)) + 1  # largest first, as many as may fit
        n = np.minimum(upto_n[:runs], most)
        heads = np.concatenate([[0], n]), np.concatenate([[0], np.cumsum(np.diff(n, prepend=0) * sizes[:runs])])
        back_n = np.cumsum(counts[::-1])
        tails = np.concatenate([[0], back_n]), np.concatenate([[0], np.cumsum((counts * sizes)[::-1])])

        def upper(f: np.ndarray, sums, own: np.ndarray) -> np.ndarray:
            """Bytes of the first f files of runs."""
            at = np.clip(np.searchsorted(sums[0], f, "left") - 1, 0, len(own) - 1)
            return sums[1][at] + (f - sums[0][at]) * own[at]

        def fitting(room: np.ndarray) -> np.ndarray:
            at = np.searchsorted(heads[1], room, "right") - 1
            whole = at >= runs
            at = np.minimum(at, runs - 1)
            more = np.minimum((room - heads[1][at]) // sizes[at], heads[0][at + 1] - heads[0][at])
            return np.where(whole, most, heads[0][at] + more)

        def closed(fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Batches opened and bytes in the last one, if files are left."""
            rest = total - fill
            full = (rest - 1) // k
            return full + 1, upper(rest - full * k, tails, sizes[::-1])

        first = 0 if self.moved is None else 1
        fill = fitting(self.limit - self.bytes[first:])
        opened, left = closed(np.minimum(fill, total - 1))
        stay = fill == total
        prefix = upper(fill, heads, sizes)
        batches = self.batches[first:] + np.where(stay, 0, opened)
        held = np.where(stay, self.bytes[first:] + prefix, left)
        upto = self.upto[first:]
        if first:
            highest, moved = self.upto[0], self.moved
            ends = np.array([highest + moved, moved], dtype=np.int64)
            low, high = (int(x) for x in fitting(self.limit - ends))
            some = np.arange(high, low - 1, -1, dtype=np.int64)
            bounds = np.minimum(self.limit - moved - upper(some, heads, sizes), highest)
            self.moved = None
            new = np.zeros_like(some), np.zeros_like(some)
            if high == total:
                self.moved = moved + int(upper(np.array([total]), heads, sizes)[0])
                opened, left = closed(some[1:])
                new = np.concatenate([[0], opened]), np.concatenate([[0], left])
            else:
                new = closed(some)
            upto = np.concatenate([bounds, upto])
            batches, held = np.concatenate([new[0], batches]), np.concatenate([new[1], held])
        # neighbours with one outcome are one piece
        last = np.ones(len(upto), dtype=bool)
        last[:-1] = (batches[1:] != batches[:-1]) | (held[1:] != held[:-1])
        if self.moved is not None:
            last[0] = True
        self.upto, self.batches, self.bytes = upto[last], batches[last], held[last]

    def after(self, batch: int, open_bytes: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.upto, open_bytes))
        if at == 0 and self.moved is not None:
            return batch, open_bytes + self.moved
        return batch + int(self.batches[at]), int(self.bytes[at])


def _classes(rows: list[tuple]):
    """(class, count, edge) from rows (class, size, n, upto) in order."""
    for k, lines in groupby(rows, key=lambda r: r[0]):
        lines = list(lines)
        yield k, lines[-1][3], [(size, n) for _, size, n, _ in lines]


class _Batches(Rule):
    """One row of the class table at the first edge of every class."""

    reads = ("_class", "size", "n", "upto")
    adds = T.StructType(_CLASS_TABLE)
    start = (0, None)

    def __init__(self, limit: int):
        self.limit, self.root = limit, math.isqrt(limit)

    def fold(self, state, rows):
        fold, out = _Fold(self.limit, *state), []
        for k, total, edge in _classes(rows):
            out.append(fold.add(k, total, edge)[1:])
            out += [(None,) * len(_CLASS_TABLE)] * (len(edge) - 1)
        return out

    def summary(self, rows):
        if rows[-1][0] > self.root:
            return None  # the last range of its group, nothing comes after it
        alone, steps = _Fold(self.limit), _Steps(self.limit)
        for k, total, edge in _classes(rows):
            alone.add(k, total, edge)
            if k:
                steps.add(k, total, edge)
        return (alone.batch, alone.open_bytes), steps

    def advance(self, state, summary):
        if summary is None:
            return state
        (batches, open_bytes), steps = summary
        if state[1] is None:
            return state[0] + batches, open_bytes
        return steps.after(*state)


class _Edges(Rule):
    """``upto``: files of the class up to this size; ``edge``: whether the fold may need the size.

    Needed are sizes among the first k files of a class, and among its last k.  What is last is only known in a
    range, so every range keeps its own last ones.
    """

    reads = ("_class", "n")
    adds = T.StructType([T.StructField("upto", T.LongType()), T.StructField("edge", T.BooleanType())])
    start = 0

    def fold(self, state, rows):
        behind, out = sum(n for _, n in rows), []
        for i, (k, n) in enumerate(rows):
            behind -= n
            last = i == len(rows) - 1
            out.append((state + n, last if k == 0 else last or state < k or behind < k))
            state += n
        return out

    def summary(self, rows):
        return sum(n for _, n in rows)

    def advance(self, state, summary):
        return state + summary


def _class_of(limit: int):
    return F.expr(f"{int(limit)}L div nullif(size, 0L)")


def histogram(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, size, n): files of every size above 0, written once."""
    counts = rows.filter("size > 0").groupBy(*group, "size").agg(F.count("*").alias("n"))
    return save(counts, "histogram", rows=counted())


def class_table(sizes: DataFrame, limit: int, group: Sequence[str] = (), range_rows: int | None = None) -> DataFrame:
    """Per group and class of a ``histogram``: its count and how its files fall into batches."""
    group = list(group)
    classed = sizes.withColumn("_class", _class_of(limit))
    edges = scan(classed, [*group, "_class"], [F.desc("size")], _Edges(), range_rows)
    edges = edges.filter("edge").select(*group, "_class", "size", "n", "upto")
    # classes above the root of the limit hold one size each; these, bounded by the limit, are one range
    cut = [F.least("_class", F.lit(math.isqrt(limit) + 1))]
    order = [F.col("_class"), F.desc("size")]
    folded = scan(edges, group, order, _Batches(limit), range_rows, cut)
    return folded.filter("class_n is not null").select(*group, "_class", *[f.name for f in _CLASS_TABLE])


def batches_needed(sizes: DataFrame, limit: int) -> DataFrame:
    """One row ``batches``: how many a ``histogram`` needs, without placing a single file."""
    last = class_table(sizes, limit).agg(F.max("last_batch").alias("last"))
    return last.select(F.coalesce("last", F.lit(0)).cast("long").alias("batches"))


def batch_count(rows: DataFrame, limit: int) -> int:
    return batches_needed(histogram(rows), limit).first()[0]


def pack(
    rows: DataFrame,
    limit: int,
    group: Sequence[str] = (),
    path: str = "path",
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``batch`` (from 1, per group) to every non-empty file of ``rows``.

    Equal sizes are taken in path order.  Pass narrow rows: they are written once.
    """
    group = list(group)
    placed = save(rows.filter("size > 0").withColumn("_class", _class_of(limit)), "sized", rows=counted())
    keys = [*group, "_class"]
    table = class_table(histogram(placed, group), limit, group, group_rows)
    numbered = number_rows(placed, keys, [F.desc("size"), F.col(path)], "_pos", group_rows)
    known = attach(numbered, table, keys, "class_n", "inner", group_rows)
    return _place(known).select(*rows.columns, "batch")


def _place(rows: DataFrame) -> DataFrame:
    position = "_pos - 1 - fill"
    return rows.withColumn(
        "batch",
        F.expr(
            f"case when {position} < 0 then open_batch"
            f" else next_batch + ({position}) div greatest(_class, 1) end"
        ),
    )


def batch_totals(packed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Files and bytes per batch, with the name of its directory."""
    totals = packed.groupBy(*group, "batch").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes")
    )
    return totals.withColumn("directory", names.batch_dir(F.col("batch")))
