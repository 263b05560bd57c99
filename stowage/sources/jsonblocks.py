"""A digest file in JSON of any layout, read by many tasks.

The text is split at double quotes, so even a file without a line break is cut into blocks that tasks read side by
side.  What a piece between two quotes means depends on all text before it: whether it lies in a string,
how deep, and below which keys.  Every block therefore first tabulates what it does to that state, once for a
start outside and once for a start inside a string; the tables of consecutive blocks compose (see
``operators.scan``), and with the state at its start every block is read for good.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.operators.scan import Rule, scan

#: Where a string began: in the block, as the one open at its start, or as the last one closed before it.
_HERE, _OPEN, _LAST = 0, 1, 2
_LITERAL = re.compile(r"\s*:\s*([^\s,:\[\]{}]+)")
_ODD_END = re.compile(r"(?<!\\)(?:\\\\)*\\\Z")

Text = tuple[int, str]


@dataclass
class State:
    """Between two pieces.  ``keys`` holds the last key of every depth, ``last`` a string that was just closed."""

    inside: bool = False
    depth: int = 0
    keys: dict[int, Text] = field(default_factory=dict)
    last: Text | None = None
    partial: Text | None = None


def _step(state: State, piece: str):
    """Take the next piece; gives (depth, string) of a value before it, or (depth, literal) as bytes."""
    if state.inside:
        where, text = state.partial or (_HERE, "")
        if _ODD_END.search(piece):  # an escaped quote
            state.partial = where, text + piece + '"'
        else:
            state.last, state.partial, state.inside = (where, text + piece), None, False
        return None
    found = None
    bare = piece.lstrip()
    if state.last is not None and bare:
        if bare.startswith(":"):
            state.keys[state.depth] = state.last
            literal = _LITERAL.match(piece)
            if literal:
                found = state.depth, literal.group(1).encode()
        else:
            found = state.depth, state.last
        state.last = None
    for c in bare:
        if c in "{[":
            state.depth += 1
        elif c in "}]":
            state.depth -= 1
    return found


def _take(state: State, piece: str):
    """``_step``, and into the next piece: a quote ends every piece."""
    was_inside = state.inside
    found = _step(state, piece)
    if not was_inside:
        state.inside, state.partial = True, (_HERE, "")
    return found


def _starts(first: bool) -> list[State]:
    """What a block begins with, outside and inside a string, the strings before it left open.

    ``first`` if it begins a file, which is never in a string.
    """
    out = []
    for inside in (False, True):
        outside = first or not inside
        out.append(State(not outside, last=(_LAST, "") if outside else None, partial=None if outside else (_OPEN, "")))
    return out


_PARTS = ("inside", "depth", "keys", "last", "partial")


def _dumps(*states: State) -> str:
    """States as text.  A pickle would carry the class, which is many times larger than a state."""
    return json.dumps([[getattr(s, p) for p in _PARTS] for s in states])


def _loads(text: str) -> list[State]:
    def known(pair):
        return None if pair is None else tuple(pair)

    return [
        State(inside, depth, {int(d): tuple(k) for d, k in keys.items()}, known(last), known(partial))
        for inside, depth, keys, last, partial in json.loads(text)
    ]


def _resolved(text: Text | None, state: State) -> Text | None:
    if text is None or text[0] == _HERE:
        return text
    before = state.partial if text[0] == _OPEN else state.last
    return None if before is None else (_HERE, before[1] + text[1])


class _Blocks(Rule):
    """The state before every block of a file, and of the next file."""

    reads = ("effect", "block")
    adds = T.StructType([T.StructField("state", T.StringType())])
    start = State()

    def fold(self, state, rows):
        out = []
        for effect, block in rows:
            # a file never begins in a string
            out.append((_dumps(state if block else replace(state, inside=False, partial=None)),))
            state = self.advance(state, [_loads(effect)])
        return out

    def summary(self, rows):
        return [_loads(effect) for effect, _ in rows]

    def advance(self, state, summary):
        for effects in summary:
            effect = effects[state.inside]
            keys = dict(state.keys)
            for depth, key in effect.keys.items():
                now = _resolved(key, state)
                if now is not None:
                    keys[state.depth + depth] = now
            keys = {d: k for d, k in keys.items() if d <= 2}
            state = State(
                effect.inside,
                state.depth + effect.depth,
                keys,
                _resolved(effect.last, state),
                _resolved(effect.partial, state),
            )
        return state


def _tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: file, block, its first place, effect.  Pieces are taken one by one, none is kept."""

    def row(block, states):
        return pa.RecordBatch.from_pylist([dict(zip(names, (*block, _dumps(*states))))], schema)

    names = ["file", "block", "first", "effect"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string()])))
    now, states = None, []
    for batch in batches:
        # a batch names few blocks
        files = batch.column(0).dictionary_encode()
        blocks = list(zip(files.indices.to_pylist(), batch.column(1).to_pylist()))
        was = None
        for i, (block, piece) in enumerate(zip(blocks, batch.column(2).to_pylist())):
            if block != was:
                was = block
                here = files.dictionary[block[0]].as_py(), block[1]
                if now is None or here != now[:2]:
                    if now is not None:
                        yield row(now, states)
                    now = *here, batch.column(3)[i].as_py()
                    states = _starts(here[1] == 0)
            for state in states:
                _take(state, piece)
    if now is not None:
        yield row(now, states)


_FOUND = "kind string, key string, value string"


def _decoded(text: str) -> str:
    return json.loads(f'"{text}"')


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths below their digest, and the members of the metadata; the first piece of a block has its state."""
    state = State()
    for batch in batches:
        out = []
        for piece, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if start is not None:
                (state,) = _loads(start)
            found = _take(state, piece)
            if found is None:
                continue
            depth, value = found
            section = state.keys.get(1, (0, ""))[1]
            key = state.keys.get(2, (0, ""))[1]
            text = value.decode() if isinstance(value, bytes) else _decoded(value[1])
            if section == "hashes" and depth == 3 and not isinstance(value, bytes):
                out.append(("path", _decoded(key), text))
            elif section == "metadata" and depth == 2:
                out.append(("fact", _decoded(key), text))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in zip(*out)], ["kind", "key", "value"]
            )


def read(spark: SparkSession, file: str) -> DataFrame:
    """Rows (kind, key, value): 'path' rows hold digest and path, 'fact' rows the metadata.

    ``file`` is a JSON document, or a folder of parts that make one in the order of their names; parts are cut
    between two tokens.  A task reads a block (spark.sql.files.maxPartitionBytes) piece by piece, whatever its size.
    """
    pieces = spark.read.option("lineSep", '"').text(file).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("piece"),
        F.monotonically_increasing_id().alias("at"),
    )
    effects = pieces.mapInArrow(_tabulate, "file string, block long, first long, effect string")
    states = scan(effects, [], [F.col("file"), F.col("block")], _Blocks())
    # one small row a block, which leaves the pieces where they are, in their order
    known = pieces.join(F.broadcast(states.select("file", "block", "first", "state")), ["file", "block"], "left")
    lost = F.raise_error(F.lit("the file has changed while it was read")).cast("long")
    start = F.when(F.col("at") == F.coalesce("first", lost), F.col("state"))
    return known.select("piece", start.alias("state")).mapInArrow(_read, _FOUND)
