"""Document fingerprints from prefix arrays of polynomial hashes.

``Prefixes`` holds the modular prefix array of a text: any two spans are compared in constant
time, and the longest common extension of two places is found by binary search.  A fingerprint
is the array thinned out to a few places counted from either end, so that two
fingerprints still tell how far their texts agree from the start and from the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import pick
from stowage.llm.ranges import RANGE_ROWS, first_keys, range_of

#: Places of the prefix array that a fingerprint keeps from either end, at most.
PLACES = 32

_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1597334677)
_STEP = 1 << 16
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(length: int) -> list[np.ndarray]:
    """Powers of either base below ``length``, kept for later texts."""
    for m, (prime, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
        while len(_powers[m]) < length:
            known = _powers[m]
            lift = np.uint64(pow(base, len(known), prime))
            _powers[m] = np.concatenate([known, known * lift % np.uint64(prime)])
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix hashes of a text under two moduli: ``at[m][i]`` sums code * base**j over j < i."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        powers = _power_table(self.size + 1)
        self.at = []
        for m, prime in enumerate(_PRIMES):
            p = np.uint64(prime)
            sums = np.zeros(self.size + 1, np.uint64)
            # terms are below 2**31, so sums stay exact for texts of up to 2**32 code points
            terms = (codes.astype(np.uint64) + np.uint64(1)) * powers[m][: self.size] % p
            np.cumsum(terms, out=sums[1:])
            self.at.append(sums % p)

    def span(self, start: int, end: int, shift: int) -> tuple[int, int]:
        """Hash of a span as if it began at ``shift`` (at least ``start``)."""
        out = []
        for m, prime in enumerate(_PRIMES):
            held = (int(self.at[m][end]) - int(self.at[m][start])) % prime
            out.append(held * pow(_BASES[m], shift - start, prime) % prime)
        return out[0], out[1]

    def whole(self) -> int:
        a, b = self.span(0, self.size, 0)
        return a << 31 | b


def same_span(x: Prefixes, i: int, y: Prefixes, j: int, length: int) -> bool:
    """Whether the spans of ``length`` at i in x and at j in y are equal."""
    shift = max(i, j)
    return x.span(i, i + length, shift) == y.span(j, j + length, shift)


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """Length of the longest common span that begins at i in x and at j in y."""
    low, high = 0, min(x.size - i, y.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(x, i, y, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_ending(x: Prefixes, y: Prefixes) -> int:
    """Length of the longest span that ends both texts."""
    low, high = 0, min(x.size, y.size)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(x, x.size - middle, y, y.size - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _stride(size: int) -> int:
    stride = 1
    while size > stride * PLACES:
        stride *= 2
    return stride


def fingerprint(text: Prefixes) -> str:
    """``length.hash.prefixes.suffixes``, all hexadecimal.

    The length and the hash cover the whole text.  Prefixes and suffixes hold eight digits for the
    spans of one, two, three ... strides from the start and to the end; the stride is the
    smallest power of two that leaves at most PLACES of them.
    """
    n, stride = text.size, _stride(text.size)

    def digits(pair: tuple[int, int]) -> str:
        return f"{(pair[0] * 2654435761 + pair[1]) & 0xFFFFFFFF:08x}"

    places = range(stride, n + 1, stride)
    heads = "".join(digits(text.span(0, p, 0)) for p in places)
    # a suffix is hashed as if the text began where the suffix does
    tails = []
    for p in places:
        pair = []
        for m, prime in enumerate(_PRIMES):
            held = (int(text.at[m][n]) - int(text.at[m][n - p])) % prime
            pair.append(held * pow(_BASES[m], -(n - p), prime) % prime)
        tails.append(digits((pair[0], pair[1])))
    return f"{n:x}.{text.whole():016x}.{heads}.{''.join(tails)}"


def _agree(x: str, y: str, every: int, over: int) -> int:
    """How many shared places of two lists of places are equal, by binary search."""
    low, high = 0, min(len(x) // (8 * every), len(y) // (8 * over))
    while low < high:
        middle = (low + high + 1) // 2
        i, j = middle * every * 8, middle * over * 8
        if x[i - 8 : i] == y[j - 8 : j]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(x: str, y: str) -> float:
    """Share of the longer text that two fingerprints show to agree from the start and the end.

    1 exactly if length and hash are equal.  Otherwise a common prefix or suffix counts down
    to the last shared place, so the share is low by two strides at most.
    """
    n_x, hash_x, head_x, tail_x = x.split(".")
    n_y, hash_y, head_y, tail_y = y.split(".")
    if (n_x, hash_x) == (n_y, hash_y):
        return 1.0
    size_x, size_y = int(n_x, 16), int(n_y, 16)
    stride_x, stride_y = _stride(size_x), _stride(size_y)
    stride = max(stride_x, stride_y)
    every, over = stride // stride_x, stride // stride_y
    start = _agree(head_x, head_y, every, over) * stride
    end = _agree(tail_x, tail_y, every, over) * stride
    return min(start + end, min(size_x, size_y)) / max(size_x, size_y)


def _deal(batches, firsts: list[tuple]):
    """Every row with its range; the first rows of a range also go behind the range before."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        take, ranges, tails = [], [], []
        for i, key in enumerate(zip(*columns, strict=True)):
            r = range_of(firsts, key)
            take.append(i)
            ranges.append(r)
            tails.append(0)
            if key == firsts[r]:
                take.append(i)
                ranges.append((r - 1) % len(firsts))
                tails.append(1)
        dealt = batch.take(pa.array(take, pa.int64()))
        yield pa.record_batch(
            [pa.array(ranges, pa.int32()), pa.array(tails, pa.int32()), *dealt.columns],
            ["_range", "_tail", *batch.schema.names],
        )


def _result(doc: tuple, following: tuple) -> tuple:
    doc_id, text, codes, made, prefixes = doc
    _, next_text, next_codes, next_made, next_prefixes = following
    n = len(codes)
    cut = n - n // 2
    # a later prefix array of the edited text starts like that of the text
    edited = fingerprint(Prefixes(np.concatenate([codes[:cut], next_codes[: n // 2]])))
    raw = (text[:cut] + next_text[: n // 2]).encode("utf-8", "surrogatepass")
    digest = hashlib.sha256(raw).hexdigest()
    common = common_extension(prefixes, 0, next_prefixes, 0), common_ending(prefixes, next_prefixes)
    return (doc_id, n, digest, made, edited, likeness(made, edited), likeness(made, next_made), *common)


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
    ("start_next", pa.int64()),
    ("end_next", pa.int64()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
    return pa.record_batch(
        [pa.array(list(c), kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)],
        [name for name, _ in _FIELDS],
    )


def _sweep(batches):
    """Rows sorted by range, tail and key: each document with the one behind it."""
    held, at, over = None, None, False
    for batch in batches:
        out = []
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in ("_range", "_tail", "has", "id", "text")]
        for r, tail, has, doc_id, text in zip(*columns, strict=True):
            if r != at:
                held, at, over = None, r, False
            if over:
                continue
            text = text or ""
            codes = code_points(text)
            prefixes = Prefixes(codes)
            row = (doc_id if has else None, text, codes, fingerprint(prefixes), prefixes)
            if held is not None:
                out.append(_result(held, row))
            held, over = row, bool(tail)
        yield _batch(out)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    ``near_edited`` and ``near_next`` are what the fingerprints alone tell, so they may be low by two strides;
    ``start_next`` and ``end_next`` are the exact lengths that the text and the next one have in common, from the
    prefix arrays.

    The edited text has its last n // 2 code points replaced by the first as many (or all) of the next
    document in ascending order of ``key`` (then of a hash of the text; rows without a key
    come first; after the last comes the first).  Null texts count as empty.  Equal texts have equal
    fingerprints.  A repeated row comes back as often as it occurs, and is followed by its
    copy.  Texts may have any length up to 2**32; a single document follows itself; an empty table
    gives no rows; other columns are not looked at.
    """
    docs = pick(docs, key, text).toDF("doc_id", "text")
    docs = docs.select(
        F.col("doc_id").isNotNull().cast("int").alias("has"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"),
        "text",
    )
    order = ["has", "id", "tie"]
    firsts = first_keys(docs, order, range_rows)

    def deal(batches):
        return _deal(batches, firsts)

    dealt = docs.mapInArrow(
        deal, "_range int, _tail int, has int, id long, tie long, text string"
    )
    dealt = dealt.repartitionById(max(len(firsts), 1), F.col("_range"))
    dealt = dealt.sortWithinPartitions("_range", "_tail", *order)
    found = dealt.mapInArrow(
        _sweep,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double, start_next long, end_next long",
    )
    return found.withColumnRenamed("doc_id", key)
