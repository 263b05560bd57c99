"""Target names that collide with nothing.

The first claim on a free name gets it.  Further claims get the base name with an index,
in one of three styles:

    plain    a.t  a_1.t    a_2.t      a_3.t
    padded   a.t  a_001.t  a_002.t    a_003.t
    chained  a.t  a_1.t    a_1_2.t    a_1_2_3.t

Names already in the target directory hold their places.  Claims are served in the given order: a file
called ``a_1.t`` keeps its name only if no copy of ``a.t`` got it before.

A generated name belongs to exactly one base, so the claims on a base meet others in two ways alone.  An
index of the base is taken from the moment its name is first claimed by itself, which is known
beforehand, whoever then gets it.  And the base's own name may have gone to a copy of a shorter base
before it was first claimed.  Without the latter, further claims take ascending indices: the
q-th one takes the first index above its predecessor's that is not taken yet.  Let r be the
further claims before index k is claimed by itself, and s the indices below k that were passed over; then k
is passed over as well if s < k - r.  This carries one number along the indices that look taken (see
``scan``).  A passed-over index lies at claim k - s, and a claim's index is its place on the line of claims and
passed-over indices.  Bases whose own name was taken are settled again; this ends after
as many rounds as names nest (``a_1_1.t`` in ``a_1.t`` in ``a.t``).

Chained names spell out all their indices, so those of one base have quadratic length in all.  They are made
in the last step alone, by rows dealt out by the bytes they become.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.names import stem_of, suffix_of
from stowage.operators.scan import Rule, scan
from stowage.operators.scratch import counted, fact, row_count, save
from stowage.operators.skew import GROUP_ROWS, attach, number_rows, sort_tasks

STYLES = ("plain", "padded", "chained")
#: Bytes of chains that a single task may spell.
TASK_BYTES = 256_000_000
#: Indices of the longest text that chains are cut from; it is part of the plan.
TEXT_INDICES = 200_000


def _steps(first: int, last: Column) -> Column:
    steps = F.sequence(F.lit(first).cast("bigint"), F.greatest(last, F.lit(first)))
    return F.concat(F.lit("_"), F.array_join(steps, "_"))


def _chain(index: Column, known: int = 0) -> Column:
    """The first ``known`` indices are cut from one text, which is much faster than to join them for every name."""
    if not known:
        return _steps(1, index)
    text = F.lit("".join(f"_{i}" for i in range(1, known + 1)).encode())
    length = _chain_bytes(F.least(index, F.lit(known))).cast("int")
    head = F.substring(text, F.lit(1), length).cast("string")
    return F.when(index <= known, head).otherwise(F.concat(head, _steps(known + 1, index)))


def _chain_bytes(index: Column) -> Column:
    """A line for each index, and a digit for each that has a first, a second ... one."""
    return reduce(add, [F.greatest(index - (10**d - 1), F.lit(0)) for d in range(18)], index)


def _by_style(style: Column, **ways: Column) -> Column:
    chosen = F.when(style == "plain", ways["plain"]).when(style == "padded", ways["padded"])
    return chosen.when(style == "chained", ways["chained"])


def _ending(index: Column, style: Column, known: int = 0) -> Column:
    return _by_style(
        style,
        plain=F.concat(F.lit("_"), index.cast("string")),
        padded=F.format_string("_%03d", index),
        chained=_chain(index, known),
    )


def _as_column(style: str | Column) -> Column:
    if isinstance(style, Column):
        return style
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    return F.lit(style)


def indexed_name(
    name: Column, index: Column, style: str | Column, longest: int | None = None, known: int = 0
) -> Column:
    """The name with its index, from 1; index 0 is the name itself.

    Null if it has more than ``longest`` bytes.  Chains up to about index ``known`` are spelled fast.
    """
    style = _as_column(style)
    reached = index
    if longest is not None:  # a chain is longer than its last index
        reached = F.when(style == "chained", F.least(index, F.lit(longest).cast("bigint"))).otherwise(index)
    renamed = F.concat(stem_of(name), _ending(reached, style, known), suffix_of(name))
    final = F.when(index > 0, renamed).otherwise(name)
    return final if longest is None else F.when(F.octet_length(final) <= longest, final)


def _occupied(taken: DataFrame) -> DataFrame:
    """(dir, name, index) and the row of the taken name, as ``taken``: which index of which base it stands for."""
    # 'a.' has no suffix, so 'a._1' is an index of 'a.' although '._1' looks like a suffix.
    dotted = suffix_of(F.col("name")).rlike(r"\A\._[0-9]+\z")
    stem = F.when(dotted, F.col("name")).otherwise(stem_of(F.col("name")))
    suffix = F.when(dotted, F.lit("")).otherwise(suffix_of(F.col("name")))
    digits = F.regexp_extract("stem", r"_([0-9]{1,18})\z", 1)
    # a chain is longer than its last index; never build a longer one
    chained = F.col("style") == "chained"
    parsed = (
        taken.filter(F.col("name").contains("_"))
        .select("dir", "style", stem.alias("stem"), suffix.alias("suffix"), F.struct("*").alias("taken"))
        .withColumn("digits", digits)
        .filter("digits <> ''")
        .withColumn("index", F.col("digits").try_cast("bigint"))
        .filter((F.col("index") > 0) & (~chained | (F.col("index") <= F.length("stem"))))
    )
    index = F.col("index")
    bounded = F.when(chained, F.least(index, F.length("stem").cast("bigint"))).otherwise(index)
    ending = _ending(bounded, F.col("style"))
    base = F.left("stem", F.length("stem") - F.length(ending))
    return (
        parsed.filter(F.col("stem").endswith(ending))
        .filter(base != "")
        .select("dir", F.concat(base, F.col("suffix")).alias("name"), "index", "taken")
    )


def resolve(
    claims: DataFrame,
    directory: str,
    name: str,
    order: Sequence[str],
    style: str | Column,
    existing: DataFrame | None = None,
    out: str = "final_name",
    group_rows: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Add ``out``, a name no other claim and no entry of ``existing`` has.

    ``existing`` holds the same directory and name columns.  ``order`` makes claims of one
    directory unique; pass narrow rows, they are written once.  With ``longest``, names of more
    bytes than that are null.  ``style`` may be a column of both tables, the same for all rows of a directory.
    """
    style = _as_column(style)
    held = claims.columns
    rows = claims.select(
        F.col(directory).alias("dir"),
        F.col(name).alias("name"),
        style.alias("style"),
        F.lit(1).alias("turn"),
        F.struct(*held).alias("claim"),
    )
    if existing is not None:
        before = existing.select(F.col(directory).alias("dir"), F.col(name).alias("name"), style.alias("style"))
        before = before.distinct().withColumn("turn", F.lit(0))
        rows = rows.unionByName(before, allowMissingColumns=True)
    time = [F.col("turn"), *[F.col(f"claim.{o}") for o in order]]
    chained = F.when(F.col("style") == "chained", F.col("place"))
    spelled, last = F.sum(_chain_bytes(chained).cast("double")), F.max(chained)
    facts = {"rows": counted(), "spelled": spelled, "last": last} if longest is None else {}
    numbered = save(number_rows(rows, ["dir", "name"], time, "place", group_rows), "places", **facts)

    marks = _marks(numbered, group_rows)
    if marks is None:
        index = numbered.withColumn("index", F.col("place") - 1)
    else:
        index = _settled(numbered, marks, list(order), group_rows)
    named, known = index.filter("turn = 1"), 0
    if longest is None:
        known = min(fact(numbered, "last", last) or 0, TEXT_INDICES)
        tasks = int((fact(numbered, "spelled", spelled) or 0) // TASK_BYTES)
        if tasks:
            tasks += sort_tasks(claims.sparkSession, row_count(numbered), group_rows or GROUP_ROWS)
            named = _dealt(named.select("claim", *_KEYS, "style", "index"), tasks)
    final = indexed_name(F.col("name"), F.col("index"), F.col("style"), longest, known)
    return named.select("claim.*", final.alias(out))


_KEYS = ["dir", "name"]


def _dealt(named: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt out by the bytes of their names: claims of one base go in pieces, of which a task spells some eight.

    Narrow rows of equal number would make tasks that spell hundreds of times more than others.  In a task names follow
    one another by their indices, so that a writer that looks back finds most of a chain in the one before.
    """
    index = F.col("index")
    # of all names of a base up to this index, at most
    bytes_before = index * (F.octet_length("name") + 24) + F.when(
        F.col("style") == "chained", index.cast("double") * (index + 1) / 2 * (F.length(index.cast("string")) + 1)
    ).otherwise(0)
    piece = F.floor(bytes_before / max(1, TASK_BYTES // 8))
    return named.repartition(tasks, *_KEYS, piece).sortWithinPartitions(*_KEYS, "index")


def _marks(numbered: DataFrame, group_rows: int | None) -> DataFrame | None:
    """Indices that names claimed by themselves occupy, within reach of their base; None if there are none.

    ``taken`` is the first claim on such a name.
    """
    occupied = save(_occupied(numbered.filter("place = 1").drop("place")), "indices", rows=counted())
    if not row_count(occupied):
        return None
    held = occupied.groupBy(*_KEYS).agg(F.count("*").alias("held"))
    claims = numbered.groupBy(*_KEYS).agg(F.count("*").alias("claims"))
    bases = held.join(claims, _KEYS)
    # An index above claims + held is out of reach.
    reached = attach(occupied, bases, _KEYS, "held", group_rows=group_rows)
    reached = save(reached.filter("index <= claims + held").select(*_KEYS, "index", "taken"), "reached", rows=counted())
    return reached if row_count(reached) else None


def _settled(
    numbered: DataFrame, marks: DataFrame, order: Sequence[str], group_rows: int | None
) -> DataFrame:
    """``numbered`` with ``index``, every base settled by what was taken before its first claim."""
    size = numbered.groupBy(*_KEYS).agg(F.count("*").alias("_n"))
    bases = marks.select(*_KEYS).distinct().join(size, _KEYS).withColumn("gone", F.lit(False))
    bases = save(bases, "bases")
    busy, gone = bases, bases
    lines = used = None
    while True:
        mine = save(attach(numbered, busy, _KEYS, "_n", "inner", group_rows), "claims")
        todo = marks.join(busy.select(*_KEYS, "gone"), _KEYS)
        walked = save(_walked(mine, todo, order, group_rows), "walked")
        new_lines = _line(mine, walked, group_rows)
        # names that a copy of the base got before they were first claimed
        new_used = walked.filter("not skipped").selectExpr(
            "taken.dir as dir", "taken.name as name", "name as base"
        )
        if lines is not None:
            done = busy.select(*_KEYS)
            new_lines = lines.join(done, _KEYS, "left_anti").unionByName(new_lines)
            old = used.join(done.toDF("dir", "base"), ["dir", "base"], "left_anti")
            new_used = old.unionByName(new_used)
        lines, used = save(new_lines, "lines"), save(new_used, "used")
        # bases to settle again: those whose own name changed hands
        now = used.select(*_KEYS).withColumn("now", F.lit(True))
        asked = gone.join(now, _KEYS, "left").withColumn("now", F.coalesce("now", F.lit(False)))
        asked = save(asked, "gone")
        changed = asked.filter("gone <> now").drop("gone").withColumnRenamed("now", "gone")
        gone = asked.drop("gone").withColumnRenamed("now", "gone")
        if changed.isEmpty():
            break
        busy = changed
    settled = lines.select(*numbered.columns, "index")
    # names without marks of their own: their claims have the indices from 0 on, or from 1
    simple = numbered.groupBy(*_KEYS).agg(F.count("*").alias("_n"))
    simple = simple.join(bases.select(*_KEYS), _KEYS, "left_anti")
    simple = simple.join(used.select(*_KEYS, F.lit(1).alias("shift")), _KEYS, "left")
    rest = attach(numbered, simple, _KEYS, "_n", "inner", group_rows)
    rest = rest.withColumn("index", F.col("place") - 1 + F.coalesce("shift", F.lit(0)))
    return settled.unionByName(rest.select(*numbered.columns, "index"))


class _Skips(Rule):
    """Which indices are passed over; the state counts them.

    A range of indices turns a count c into c + (thresholds above c): index k with ``due`` = k - r adds one to
    counts below the threshold at which the count has reached ``due``, and that is the free whole
    number number ``due`` - (thresholds so far).  So a range is summed up by a set of thresholds.
    """

    reads = ("due",)
    adds = T.StructType([T.StructField("before", T.LongType()), T.StructField("skipped", T.BooleanType())])
    start = 0

    def fold(self, state, rows):
        out = []
        for (due,) in rows:
            skipped = state < due
            out.append((state, skipped))
            state += skipped
        return out

    def summary(self, rows):
        held: list[int] = []
        for (due,) in rows:
            nth = due - len(held)
            if nth > 0:
                below = bisect_left(range(len(held)), nth, key=lambda i: held[i] - i - 1)
                insort(held, nth + below)
        runs: list[list[int]] = []
        for t in held:
            if runs and runs[-1][1] == t - 1:
                runs[-1][1] = t
            else:
                runs.append([t, t])
        return runs

    def advance(self, state, summary):
        return state + sum(max(0, high - max(low - 1, state)) for low, high in summary)


class _Claims(Rule):
    """``claimed``: claims up to here."""

    reads = ("kind",)
    adds = T.StructType([T.StructField("claimed", T.LongType())])
    start = 0

    def fold(self, state, rows):
        out = []
        for (kind,) in rows:
            state += kind == 0
            out.append((state,))
        return out

    def summary(self, rows):
        return sum(kind == 0 for (kind,) in rows)

    def advance(self, state, summary):
        return state + summary


def _walked(mine: DataFrame, todo: DataFrame, order: Sequence[str], group_rows: int | None) -> DataFrame:
    """Marks with ``before`` (indices passed over below) and ``skipped`` (whether the index is, too)."""
    time = [F.col("turn"), *[F.col(f"_t{i}") for i in range(len(order))]]
    claims = mine.select(
        *_KEYS, "turn", *[F.col(f"claim.{o}").alias(f"_t{i}") for i, o in enumerate(order)], F.lit(0).alias("kind")
    )
    marks = todo.select(
        *_KEYS,
        F.col("taken.turn").alias("turn"),
        *[F.col(f"taken.claim.{o}").alias(f"_t{i}") for i, o in enumerate(order)],
        F.lit(1).alias("kind"),
        "index",
        F.struct("taken.dir", "taken.name").alias("taken"),
        "gone",
    )
    both = claims.unionByName(marks, allowMissingColumns=True)
    timed = scan(both, _KEYS, [*time, F.col("kind"), F.col("index")], _Claims(), group_rows).filter("kind = 1")
    # of the claims before, the first one is no further claim if it got the name itself
    further = F.greatest(F.col("claimed") - F.when(F.col("gone"), 0).otherwise(1), F.lit(0))
    rows = timed.select(*_KEYS, "index", "taken", (F.col("index") - further).alias("due"))
    return scan(rows, _KEYS, [F.col("index")], _Skips(), group_rows)


def _line(mine: DataFrame, walked: DataFrame, group_rows: int | None) -> DataFrame:
    """Claims of the bases with their index: their place on the line of claims and passed-over indices."""
    own = F.when(F.col("gone"), F.col("place")).otherwise(F.col("place") - 1)  # 0: the name itself
    mine = mine.withColumn("at", own).drop("_n", "gone")
    skipped = walked.filter("skipped").select(
        *_KEYS, (F.col("index") - F.col("before")).alias("at"), F.lit(0).alias("kind"), "index"
    )
    further = mine.filter("at > 0").withColumn("kind", F.lit(1))
    line = further.unionByName(skipped, allowMissingColumns=True)
    order = [F.col("at"), F.col("kind"), F.col("index")]
    placed = number_rows(line, _KEYS, order, "_line", group_rows).filter("kind = 1")
    columns = [c for c in mine.columns if c != "at"]
    first = mine.filter("at = 0").select(*columns, F.lit(0).cast("long").alias("index"))
    return placed.select(*columns, F.col("_line").alias("index")).unionByName(first)
