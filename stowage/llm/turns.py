"""Conversation structure repair: the cheapest edits that give every conversation the form (s?(ua)+)?.

The cost of the best repair from a row on, for the four states of the form, is a vector.  Less its
least entry it is one of a few dozen, whatever the text, and a row's symbol (must go; else initial of the role
and whether cut off) leads from the vector after it to the one before it.  As in the method of the Four
Russians, a table holds the transition of every vector under every block of ``BLOCK`` symbols:

1. Rows are numbered in one total order, cut into ranges of bounded size.  A conversation inside a range is
   walked from its end, a lookup a block.
2. A conversation that lies in several ranges gives, for each, where the range leads from every vector; these
   (at most two a range) are composed from the last range on, and name the vector at the end of each.
3. Blocks are expanded backward from the vector at their end, so every row knows the vector after it.
4. The rows of a conversation then pass once, in order, and the ASCII-least edit that keeps to the least
   cost is taken at each.  Only this pass, which digests the result, is sequential in a conversation; it
   streams, and keeps the edits and one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import groups, pick
from stowage.operators.scratch import save

#: Rows that one task orders and walks.
RANGE_ROWS = 500_000

#: Symbols in a block of the table.
BLOCK = 4

#: White space as the contract of the query states it.
SPACE = " \t\n\x0b\x0c\r"

# What edits cost.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5

# States: start, after s, after u, after a.  The role that may come next and the state it leads to.
_NEXT_ROLE = ("user", "user", "assistant", "user")
_NEXT_STATE = (2, 2, 3, 2)
_FINAL = (0, 2 * INSERT, INSERT, 0)
_STATES = range(4)

# Symbols: no row, a row that must go, then initial (s, u, a, other) of whole and of cut rows.
_NONE, _GONE, _FIRST = 0, 1, 2
_SYMBOLS = 10


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept role, if it may stand there."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    if initial == 2:
        return 3 if state == 2 else None
    return None


def _options(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, edit, next state) of the edits of a row, but for what is inserted before it."""
    found = [(DELETE + after[state], "D", state)]
    if symbol >= _FIRST:
        cut = CUT * ((symbol - _FIRST) // 4)
        kept = _kept(state, (symbol - _FIRST) % 4)
        if kept is not None:
            found.append((cut + after[kept], "K", kept))
        found.append((cut + REROLE + after[_NEXT_STATE[state]], "R", _NEXT_STATE[state]))
    return found


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    if symbol == _NONE:
        return after
    costs = [min(o[0] for o in _options(after, symbol, q)) for q in _STATES]
    for _ in _STATES:  # insertions; after two the form is where it was
        costs = [min(costs[q], INSERT + costs[_NEXT_STATE[q]]) for q in _STATES]
    return tuple(costs)


class _Tables:
    """All normalised vectors (number 0 is the end of a conversation) and their transitions."""

    def __init__(self) -> None:
        vectors, known, step = [_FINAL], {_FINAL: 0}, []
        for vector in vectors:  # grows while it is read
            row = []
            for symbol in range(_SYMBOLS):
                costs = _before(vector, symbol)
                least = min(costs)
                costs = tuple(c - least for c in costs)
                if costs not in known:
                    known[costs] = len(vectors)
                    vectors.append(costs)
                row.append(known[costs])
            step.append(row)
        self.vectors = vectors
        self.step = np.array(step, dtype=np.int16)
        # a block's code has its first symbol in the highest place; its last one is walked first
        block = np.arange(len(vectors), dtype=np.int16)[:, None]
        for _ in range(BLOCK):
            block = self.step[block].transpose(0, 2, 1).reshape(len(vectors), -1)
        self.block = np.ascontiguousarray(block)
        self.choices: dict[tuple[int, int, int], tuple[str, int]] = {}

    def choice(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """Edits of a row with the insertions before it, and the state they lead to."""
        key = (after, symbol, state)
        if key not in self.choices:
            vector = self.vectors[after]
            best = _before(vector, symbol)
            text = ""
            while True:
                options = _options(vector, symbol, state)
                options.append((INSERT + best[_NEXT_STATE[state]], "I", _NEXT_STATE[state]))
                edit, state = min((o[1], o[2]) for o in options if o[0] == best[state])
                text += edit
                if edit != "I":
                    break
            self.choices[key] = text, state
        return self.choices[key]


@lru_cache(maxsize=1)
def tables() -> _Tables:
    return _Tables()


class _Blocks:
    """Consecutive segments of symbols, each filled up to whole blocks in front."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """``starts``: where each segment begins, and the number of symbols."""
        sizes = np.diff(starts)
        self.counts = -(-sizes // BLOCK)
        self.ends = np.cumsum(self.counts)  # behind the last block of a segment
        shift = (self.ends * BLOCK - starts[1:]).repeat(sizes)
        self.place = np.arange(len(symbols)) + shift
        filled = np.zeros(int(self.counts.sum()) * BLOCK, dtype=np.int64)
        filled[self.place] = symbols
        self.symbols = filled.reshape(-1, BLOCK)
        self.codes = self.symbols @ (_SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def functions(self) -> np.ndarray:
        """For each segment: the vector before it by the vector after it."""
        table = tables().block
        out = np.empty((len(self.counts), len(table)), dtype=np.int16)
        for i, (count, end) in enumerate(zip(self.counts, self.ends)):
            now = np.arange(len(table))
            for code in self.codes[end - count : end][::-1]:
                now = table[now, code]
            out[i] = now
        return out

    def after(self, ends: np.ndarray) -> np.ndarray:
        """The vector after every symbol, by the vectors after the segments."""
        table, step = tables().block, tables().step
        order = np.argsort(-self.counts, kind="stable")
        lengths, last = self.counts[order], self.ends[order] - 1
        now = np.asarray(ends, dtype=np.int16)[order]
        behind = np.empty(len(self.codes), dtype=np.int16)
        active = len(order)
        for k in range(int(lengths[0]) if active else 0):
            while lengths[active - 1] <= k:
                active -= 1
            at = last[:active] - k
            behind[at] = now[:active]
            now[:active] = table[now[:active], self.codes[at]]
        found = np.empty(self.symbols.shape, dtype=np.int16)
        for j in range(BLOCK - 1, -1, -1):
            found[:, j] = behind
            behind = step[behind, self.symbols[:, j]]
        return found.reshape(-1)[self.place]


# --- rows and their symbols ---------------------------------------------------------------


def prepare(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversation rows; null roles and texts are one space."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """The test damage of the query: what happens to a row follows from crc32 of ``conv_id:turn``.

    A dropped row stays with 0 copies, so its conversation is still known.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *key)) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2 * F.col("copies")).otherwise(F.col("copies")).alias("copies"),
    )


#: Rows that agree here are alike; their order is the order in a conversation.
_KEY = ["conv_id", "turn", "role", "head", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("text", 1, 32), "digest": F.md5("text")})


def _symbols(rows: DataFrame) -> DataFrame:
    """One narrow row for every row that counts: key, copy, fault and symbol."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = _keyed(rows.filter("copies > 0")).select(
        *_KEY,
        "copies",
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    alike = narrow.groupBy(*_KEY).agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    )
    # nulls first: a text's first turn is null if any of its turns is
    alike = save(alike, "alike")
    any_null = F.max(F.col("turn").isNull())
    first = alike.filter("not blank").groupBy("conv_id", "role", "head", "digest")
    first = first.agg(F.when(~any_null, F.min("turn")).alias("turn")).withColumn("first", F.lit(True))
    a, b = alike.alias("a"), first.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEY]
    met = a.join(b, same, "left").select("a.*", F.coalesce("b.first", F.lit(False)).alias("first"))

    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    duplicate = ~F.col("first") | (F.col("copy") > 1)
    fault = F.when(F.col("blank"), 1).when(duplicate, 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin(1, 2), _GONE).otherwise(
        _FIRST + kind + F.when(F.col("fault") == 3, 4).otherwise(0)
    )
    each = each.withColumn("fault", fault).withColumn("symbol", symbol)
    return each.select(*_KEY, "copy", F.col("fault").cast("int"), F.col("symbol").cast("int"))


# --- walking ranges -------------------------------------------------------------------------

_WALKED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("head", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("copy", T.LongType()),
        T.StructField("fault", T.IntegerType()),
        T.StructField("symbol", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("after", T.IntegerType()),
        T.StructField("leads", T.ArrayType(T.IntegerType())),
    ]
)


def _bounds(table: pa.Table, key: str) -> np.ndarray:
    """Where runs of one value begin, and the number of rows; nulls are one value."""
    column = table[key].combine_chunks()
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])
    return np.append(np.flatnonzero(new), len(values))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range.  What may go on in another range gets no vectors but says where it leads."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    starts = _bounds(table, "conv_id")
    symbols = table["symbol"].to_numpy()
    border = np.zeros(len(starts) - 1, dtype=bool)
    border[[0, -1]] = True
    after = _Blocks(symbols, starts).after(np.zeros(len(border)))
    inner = ~border.repeat(np.diff(starts))
    leads: list = [None] * table.num_rows
    for i in np.flatnonzero(border):
        low, high = starts[i], starts[i + 1]
        part = _Blocks(symbols[low:high], np.array([0, high - low]))
        leads[low] = part.functions()[0].tolist()  # the first row of a segment tells
    yield from (
        table.append_column("after", pa.array(after, pa.int32(), mask=~inner))
        .append_column("leads", pa.array(leads, pa.list_(pa.int32())))
        .cast(_arrow(_WALKED))
        .to_batches(max_chunksize=10_000)
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_ENDS = "conv_id long, block long, end int"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector after every segment of a conversation; segments come last one first."""
    conv, now = (), 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if conv != (row["conv_id"],):
                conv, now = (row["conv_id"],), 0
            out.append((row["conv_id"], row["block"], now))
            now = row["leads"][now]
        if out:
            types = (pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "end"])


def _rewalk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border segments, whose last vector (``end``) is known by now; a range at a time."""
    for table, bounds in groups(batches, ["block"]):
        for low, high in zip(bounds, bounds[1:]):
            part = table.slice(low, high - low)
            starts = _bounds(part, "conv_id")
            ends = part["end"].to_numpy()[starts[:-1]]
            after = _Blocks(part["symbol"].to_numpy(), starts).after(ends)
            place = part.column_names.index("after")
            part = part.set_column(place, "after", pa.array(after, pa.int32()))
            yield from part.drop_columns(["end"]).cast(_arrow(_WALKED)).to_batches(max_chunksize=10_000)


def _walked(rows: DataFrame, range_rows: int) -> DataFrame:
    """The rows that count, each with its symbol and the vector after it."""
    spark = rows.sparkSession
    each = save(_symbols(rows), "symbols")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, each.count() // range_rows + 1)
    order = [F.col(k).asc_nulls_first() for k in (*_KEY, "copy")]
    ranges = each.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranges = ranges.select(
        "*", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    walked = save(ranges.mapInArrow(_walk, _WALKED), "walked")

    leads = walked.filter("leads is not null").select("conv_id", "block", "leads")
    ends = leads.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = ends.mapInArrow(_compose, _ENDS)
    border = walked.filter("after is null").alias("w").join(
        ends.alias("e"),
        F.col("w.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("w.block") == F.col("e.block")),
    )
    border = border.select("w.*", "e.end").repartition("block").sortWithinPartitions("block", "at")
    rest = border.mapInArrow(_rewalk, _WALKED)
    return walked.filter("after is not null").unionByName(rest)


# --- edits in order -------------------------------------------------------------------------


def _told(rows: DataFrame, walked: DataFrame) -> DataFrame:
    """Texts and edits, all of a conversation in one task and in order; a text comes before its rows."""
    texts = _keyed(rows).select(
        *_KEY, F.lit(0).cast("long").alias("copy"), (F.col("copies") > 0).alias("there"), "text"
    )
    edits = walked.select(*_KEY, "copy", "fault", "symbol", "after")
    both = texts.unionByName(edits, allowMissingColumns=True)
    order = [F.col(k).asc_nulls_first() for k in (*_KEY, "copy")]
    return both.repartition("conv_id").sortWithinPartitions(*order)


class _Conversation:
    """What is known of one conversation after some of its rows."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.state, self.lines, self.cost = 0, 0, 0
        self.audit: list[str] = []
        self.faults = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"\n{role}:{text}".encode() if self.lines else f"{role}:{text}".encode())
        self.lines += 1
        return self.lines, role, text

    def _insert(self) -> tuple[int, str, str]:
        self.cost += INSERT
        line = self._line(_NEXT_ROLE[self.state], "")
        self.state = _NEXT_STATE[self.state]
        return line

    def row(self, turn, role: str, text: str, fault: int, symbol: int, after: int) -> list[tuple[int, str, str]]:
        """Take the next row; the lines that come out."""
        self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        edits, state = tables().choice(after, symbol, self.state)
        self.audit.append(edits)
        out = []
        for edit in edits:
            if edit == "I":
                out.append(self._insert())
            elif edit == "D":
                self.cost += DELETE
            else:
                self.cost += CUT * (fault == 3) + REROLE * (edit == "R")
                out.append(self._line(role if edit == "K" else _NEXT_ROLE[self.state], text))
        self.state = state
        return out

    def close(self) -> list[tuple[int, str, str]]:
        out = []
        while self.state not in (0, 3):
            self.audit.append("I")
            out.append(self._insert())
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        if not -(1 << 63) <= gaps < 1 << 63:
            gaps = None
        return (
            self.conv_id,
            gaps,
            *self.faults[1:],
            self.illegal,
            self.cost,
            "".join(self.audit),
            self.hash.hexdigest(),
        )


SUMMARY = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        *[
            T.StructField(n, T.LongType())
            for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        ],
        T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ]
)

LINES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _trace(lines: bool):
    """For mapInArrow over ``_told``: the repaired lines, or a summary of each conversation."""
    schema = LINES if lines else SUMMARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        out: list[tuple] = []
        now: _Conversation | None = None
        text = ""

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        def end() -> None:
            last = now.close()
            out.extend((now.conv_id, *line) for line in last) if lines else out.append(now.summary())

        names = [*_KEY[:3], "copy", "there", "text", "fault", "symbol", "after"]
        for rows in batches:
            columns = [rows.column(n).to_pylist() for n in names]
            for conv, turn, role, copy, there, own, fault, symbol, after in zip(*columns):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        end()
                    now = _Conversation(conv)
                if copy == 0:
                    text = own if there else text
                    continue
                made = now.row(turn, role, text, fault, symbol, after)
                if lines:
                    out.extend((conv, *line) for line in made)
                if len(out) >= 1000:
                    yield batch()
            if len(out) >= 100:
                yield batch()
        if now is not None:
            end()
        if out:
            yield batch()

    return run, schema


def repaired(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, line, role, text): the repaired conversations; ``rows`` as ``prepare`` gives them."""
    function, schema = _trace(True)
    return _told(rows, _walked(rows, range_rows)).mapInArrow(function, schema)


def summaries(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for every conv_id of ``rows`` (as ``prepare`` gives them): faults, cost, edits, digest.

    Null ids are one conversation.  Null turns come first; rows of one turn are ordered by role and text (its
    first 32 characters, then md5), so repeated rows lie together and all but the first are duplicates.
    Null roles and texts are one space: such a role fits nowhere, such a text is blank.  An
    empty table gives none; a conversation without rows gives zeros, no edits and the digest of nothing.
    Further columns of the input are left out.  Texts of any length are taken whole.
    """
    function, schema = _trace(False)
    return _told(rows, _walked(rows, range_rows)).mapInArrow(function, schema)
