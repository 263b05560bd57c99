"""Sequences of a fixed window packed from a histogram of piece lengths.

Shallow combinations of lengths that fill the window are the columns of a non-negative least
squares problem; its right side is the histogram.  The solution says how often each combination
repeats; it is rounded so that the number of sequences stays (largest remainders), as far as the
histogram holds out, and a greedy best fit on the histogram places the rest.  Combinations have at least
``DEPTH`` parts, and more where pieces are short.  All of this works on lengths, at most a window of them; documents
only look up their place, so nothing that grows with the data reaches the driver.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm.common import SALTS, by_batch, pick
from stowage.operators.scratch import save

#: Tokens of a sequence.
WINDOW = 4096
#: The id behind every document.
END_ID = 2
#: Lengths are grouped into this many steps for the least squares problem.
STEPS = 32
#: Lengths that one combination has at most; twice the pieces that fill a window on average, if that is more.
DEPTH = 6
_ITERATIONS = 400
_CACHE_WORDS = 200_000
#: Pre-tokens of lower-case words in tokenizers of word ends.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Marks that most often end a word.
_MARKS = frozenset(".,!?;:)")
#: Words of characters below this one are cut here.
_LATIN = "\u0250"
#: A tokenizer that cuts these otherwise gets every word whole.
_SAMPLES = [
    "It's", "WE'LL've", "a1b22", "x--y", "(don't)", "$5.00,", "'", "''s", "~!@#%^&*", "end.", "THE",
    "Größe", "ÀÉÎ", "ñandú's", "½x²", "œuvre…", "ßÿ", "«ça»", "Łódź", "ı",
]


def _byte_letters() -> dict[int, str]:
    """The letter for every byte in vocabularies of bytes: itself if it is a printable one, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


# --- tokens ----------------------------------------------------------------------------------


class _Recent(dict):
    """Remembered values of ``make``: of the last ``size`` new keys, and of the ``size`` before them."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Encoder:
    """Ids of a tokenizers file, word by word.

    The tokenizer's pre-tokens never span white space, so words between spaces are encoded
    apart and remembered.  Words of Latin letters that are composed need no normalization but lower case; their
    pre-tokens go to the model one by one, and are remembered as well.  Texts that contain the
    string of a special token go through the tokenizer whole.
    """

    def __init__(self, path: str):
        # a task has one core; the library would start a thread for each core of the machine
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tool = Tokenizer.from_file(path)
        self._model = self._tool.model
        self._special = [t.content for t in self._tool.get_added_tokens_decoder().values()]
        self._words = _Recent(self._word, _CACHE_WORDS)
        self._parts = _Recent(self._part, _CACHE_WORDS)
        self._plain = all(self._raw([t])[0] == self._latin(t) for t in _SAMPLES)

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self._tool.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self._model.tokenize(part)]).tobytes()

    def _latin(self, word: str) -> bytes:
        if word.isalpha():
            return self._parts[word.lower()]
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return self._parts[word[:-1].lower()] + self._parts[word[-1:]]
        return b"".join(map(self._parts.__getitem__, _PARTS.findall(word.lower())))

    def _word(self, word: str) -> bytes:
        if self._plain and word.isprintable():
            if word.isascii():
                return self._latin(word)
            if max(word) < _LATIN and "İ" not in word and unicodedata.is_normalized("NFC", word):
                return self._latin(word)
        return self._raw([word])[0]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(s in text for s in self._special):
            return self._raw([text])[0]
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self._words.__getitem__, words))


_encoders: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _pieces(batch: pa.RecordBatch, path: str, window: int, end_id: int, ids: bool) -> pa.RecordBatch:
    tool = _encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    doc, start, length, crc, total, held = [], [], [], [], [], []
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        raw = tool.encode(text or "") + end
        n = len(raw) // 4
        for at in range(0, n, window):
            part = raw[at * 4 : (at + window) * 4]
            doc.append(doc_id)
            start.append(at)
            length.append(len(part) // 4)
            crc.append(zlib.crc32(part))
            total.append(n)
            if ids:
                held.append(part)
    columns = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if ids:
        columns.append(pa.array(held, pa.binary()))
        names.append("ids")
    return pa.record_batch(columns, names)


# --- the plan on lengths -----------------------------------------------------------------------


def _combinations(steps: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing step lengths with at most ``depth`` parts that add up to ``steps``."""
    out: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(parts)
            return
        if len(parts) == depth:
            return
        least = -(-left // (depth - len(parts)))
        for part in range(min(left, most), least - 1, -1):
            extend((*parts, part), left - part, part)

    extend((), steps, steps)
    return out


def _solve(matrix: np.ndarray, right: np.ndarray, iterations: int) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients.

    Rows are scaled so that lengths of few pieces weigh as much as those of many.
    """
    scale = 1 / np.sqrt(np.maximum(right, 1))
    a, b = matrix * scale[:, None], right * scale
    gram, rhs = a @ a.T, None
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    x = np.zeros(a.shape[1])
    y, momentum = x, 1.0
    for _ in range(iterations):
        rhs = a.T @ (a @ y - b)
        new = np.maximum(y - step * rhs, 0)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def _rounded(repeats: np.ndarray) -> np.ndarray:
    """Whole numbers with (nearly) the same sum: rounded down, and one more for the largest remainders."""
    whole = np.floor(repeats).astype(np.int64)
    more = int(round(float(repeats.sum()))) - int(whole.sum())
    whole[np.argsort(whole - repeats, kind="stable")[:more]] += 1
    return whole


def plan(
    histogram: dict[int, int], window: int, steps: int = STEPS, depth: int = DEPTH
) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of the pieces) of every kind of sequence; they use up the histogram.

    ``histogram`` counts the pieces of every length from 1 to ``window``.
    """
    return plan_and_share(histogram, window, steps, depth)[0]


def plan_and_share(
    histogram: dict[int, int], window: int, steps: int = STEPS, depth: int = DEPTH
) -> tuple[list[tuple[int, list[int]]], float]:
    """``plan``, and the share of the pieces shorter than the window that the least squares solution places."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    kinds: list[tuple[int, list[int]]] = []
    if left[window]:
        kinds.append((int(left[window]), [window]))
        left[window] = 0
    steps = min(steps, window)
    step = window / steps
    grid = np.minimum(np.ceil(np.arange(window + 1) / step).astype(int), steps)
    open_: dict[tuple[int, ...], int] = {}

    # repeats of combinations of steps; a step is served by its own lengths, longest first
    counts = np.bincount(grid, weights=left, minlength=steps + 1)[1:]
    pieces = int(left.sum())
    mean = float((left * np.arange(window + 1)).sum()) / max(pieces, 1)
    depth = min(steps, max(depth, round(2 * window / max(mean, 1))))
    combos = [c for c in _combinations(steps, depth) if all(counts[p - 1] for p in c)]
    if combos:
        matrix = np.zeros((steps, len(combos)))
        for j, combo in enumerate(combos):
            for part in combo:
                matrix[part - 1, j] += 1
        repeats = _rounded(_solve(matrix, counts, _ITERATIONS))
        able = [l for l in range(1, window + 1) if left[l]]
        for j in np.argsort(-repeats, kind="stable"):
            want = int(repeats[j])
            while want:
                lengths, used, room = [], {}, window

                def take(length: int) -> None:
                    lengths.append(length)
                    used[length] = used.get(length, 0) + 1

                def longest(most: int) -> int | None:
                    at = bisect_right(able, most) - 1
                    while at >= 0 and left[able[at]] <= used.get(able[at], 0):
                        at -= 1
                    return able[at] if at >= 0 else None

                # a step that is used up is served by the next shorter length
                for part in combos[j][:-1]:
                    length = longest(min(room, int(part * step)))
                    if length is not None:
                        take(length)
                        room -= length
                # the last part, and more where lengths lie below their steps, close the window
                length = longest(room)
                while length is not None:
                    take(length)
                    room -= length
                    length = longest(room)
                if not lengths:
                    break
                n = min(want, *(int(left[l]) // k for l, k in used.items()))
                for l, k in used.items():
                    left[l] -= n * k
                    if not left[l]:
                        del able[bisect_left(able, l)]
                kind = tuple(sorted(lengths, reverse=True))
                open_[kind] = open_.get(kind, 0) + n
                want -= n

    solved = 1 - int(left.sum()) / pieces if pieces else 1.0

    # greedy best fit of the rest, longest first, into the rooms that are left
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    sizes: list[int] = []

    def give(kind: tuple[int, ...], n: int) -> None:
        room = window - sum(kind)
        if room:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((n, kind))
        else:
            kinds.append((n, list(kind)))

    for kind, n in open_.items():
        give(kind, n)
    for length in range(window, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                room = sizes[at]
                have, kind = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sizes[at]
                fits = room // length
                whole = min(have, n // fits) if n >= fits else 0
                if whole:
                    used, more = whole, kind + (length,) * fits
                    n -= whole * fits
                else:
                    used, more = 1, kind + (length,) * n
                    n = 0
                if have > used:
                    give(kind, have - used)
                give(more, used)
            else:
                fits = window // length
                whole = n // fits
                if whole:
                    give((length,) * fits, whole)
                    n -= whole * fits
                if n:
                    give((length,) * n, 1)
                    n = 0
    for held in rooms.values():
        kinds += [(n, list(kind)) for n, kind in held]
    return kinds, solved


class _Places:
    """Where the i-th piece of a length goes."""

    def __init__(self, kinds: list[tuple[int, list[int]]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for repeats, lengths in kinds:
            offset = 0
            for length in lengths:
                at = taken.get(length, 0)
                slots.setdefault(length, []).append((at, first, offset))
                taken[length] = at + repeats
                offset += length
            first += repeats
        self.sequences = first
        self._slots = {l: np.array(s, np.int64) for l, s in slots.items()}

    def look_up(self, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, bounds) if len(order) else ():
            slots = self._slots[int(lengths[part[0]])]
            at = np.searchsorted(slots[:, 0], index[part], side="right") - 1
            sequence[part] = slots[at, 1] + index[part] - slots[at, 0]
            offset[part] = slots[at, 2]
        return sequence, offset


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and,
    if asked for, ids (little-endian 32-bit).

    A document's ids, with ``end_id`` behind them, are cut every ``window`` ids; each piece lies in
    one sequence, at ``offset``, and sequences hold at most ``window`` ids.  ``tokenizer`` is a
    file that every executor can read.  A null text counts as empty, so its piece is ``end_id`` alone.
    Texts may have any length; repeated rows and rows without an id are packed like any others;
    an empty table gives no rows; other columns are not looked at.
    """
    docs = pick(docs, key, text).toDF("doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if ids else ""
    pieces = docs.mapInArrow(by_batch(_pieces, tokenizer, window, end_id, ids), schema)
    salt = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(SALTS))
    pieces = save(pieces.withColumn("_salt", salt.cast("int")), "pieces")

    # at most window * SALTS rows, whatever the data
    counts = pieces.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_length.collect()}
    places = _Places(plan(histogram, window))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = pieces.withColumn("_row", F.row_number().over(inside))
    numbered = numbered.join(starts, ["length", "_salt"])
    numbered = numbered.withColumn("_index", F.col("_first") + F.col("_row") - 1)

    def place(batches):
        for batch in batches:
            names = batch.schema.names
            length, index = (batch.column(names.index(c)).to_numpy() for c in ("length", "_index"))
            sequence, offset = places.look_up(length, index)
            kept = [n for n in names if n != "_index"]
            columns = [batch.column(names.index(n)) for n in kept]
            yield pa.record_batch(
                [*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    found = numbered.select(*names, "_index").mapInArrow(
        place, f"{schema}, sequence_id long, offset long"
    )
    return found.withColumnRenamed("doc_id", key)
