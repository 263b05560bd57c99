"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Every token becomes a piece of byte-mapped characters scored by its negative rank, so that merging
by the best score is merging by the lowest rank; normalisation is the identity.  Texts are
split by the pattern first, pre-tokens are encoded by the model, and ids are decoded by the inverse
of the byte map.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import by_batch, pick

_CACHE_PIECES = 300_000


def byte_map() -> list[str]:
    """A printable character for every byte: itself if printable, else one from U+0100 on."""
    out, spare = [], 0x100
    for value in range(256):
        if 0x21 <= value <= 0x7E or 0xA1 <= value <= 0xAC or 0xAE <= value <= 0xFF:
            out.append(chr(value))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """A field of a protocol buffer message: varint, bytes or 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i + 1 is the token of the i-th rank; piece 0 is unknown."""
    mapped = byte_map()
    unknown, bpe = 2, 2  # of the enumerations of piece types and model types
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = "".join(mapped[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, bpe) + _field(4, len(pieces))
    for number in (41, 42, 43):  # no ids for begin, end and padding
        trainer += _field(number, (1 << 64) - 1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, _field(40, 0) + trainer) + _field(3, normal)


class Codec:
    """Encodes texts to the ranks of a vocabulary and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self._split = regex.compile(pattern)
        order = sorted(ranks.items(), key=lambda item: item[1])
        self._ranks = [rank for _, rank in order]
        self._known = ranks
        mapped = byte_map()
        unmapped = {c: b for b, c in enumerate(mapped)}
        self._table = str.maketrans({chr(b): c for b, c in enumerate(mapped)})
        # the inverse mapping, from the pieces of the model
        self._bytes = {
            rank: bytes(unmapped[c] for c in self._model.id_to_piece(i + 1))
            for i, rank in enumerate(self._ranks)
        }
        self._cache: dict[str, tuple[int, ...]] = {}

    def _encode_pieces(self, pieces: list[str]) -> None:
        todo = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self._known.get(raw)
            if rank is None:
                todo.append((piece, raw.decode("latin-1").translate(self._table)))
            else:
                self._cache[piece] = (rank,)
        found = self._model.encode([t[1] for t in todo], num_threads=1) if todo else []
        for (piece, _), ids in zip(todo, found, strict=True):
            self._cache[piece] = tuple(self._ranks[i - 1] for i in ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        pieces = self._split.findall(text)
        cache = self._cache
        missing = [p for p in set(pieces) if p not in cache]
        if missing:
            if len(cache) + len(missing) > _CACHE_PIECES:
                cache.clear()
                missing = list(set(pieces))
            self._encode_pieces(missing)
        ids: list[int] = []
        for piece in pieces:
            ids += cache[piece]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, made once in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _encode_batch(batch: pa.RecordBatch, path: str, pattern: str, ids: bool) -> pa.RecordBatch:
    tool = codec(path, pattern)
    decimal = _decimal(max(tool._ranks, default=0))
    counts, hashes, decoded, kept = [], [], [], []
    for text in batch.column(1).to_pylist():
        found = tool.encode(text or "")
        counts.append(len(found))
        hashes.append(hashlib.sha256(" ".join(map(decimal.__getitem__, found)).encode()).hexdigest())
        decoded.append(hashlib.sha256(tool.decode(found)).hexdigest())
        if ids:
            kept.append(found)
    columns = [
        batch.column(0),
        pa.array(counts, pa.int64()),
        pa.array(hashes, pa.string()),
        pa.array(decoded, pa.string()),
    ]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids:
        columns.append(pa.array(kept, pa.list_(pa.int32())))
        names.append("ids")
    return pa.record_batch(columns, names)


_numbers: list[str] = []


def _decimal(most: int) -> list[str]:
    while len(_numbers) <= most:
        _numbers.append(str(len(_numbers)))
    return _numbers


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    ids: bool = False,
) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path`` is a rank file that every executor can read, ``pattern`` splits texts before the
    merges.  The hashes are of the decimal ids joined by one space and of the bytes the ids
    decode to.  A null text counts as empty and gives no ids.  Texts may have any length; rows
    without an id and repeated rows come back as they are; an empty table gives no rows;
    other columns are not looked at.
    """
    docs = pick(docs, key, text).toDF("doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if ids else ""
    found = docs.mapInArrow(by_batch(_encode_batch, path, pattern, ids), schema)
    return found.withColumnRenamed("doc_id", key)


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids; a null list gives a null text, bytes that are no UTF-8 are replaced."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(path, pattern)
        found = [
            None if x is None else tool.decode(x).decode("utf-8", "replace")
            for x in batch.column(1).to_pylist()
        ]
        return pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    rows = pick(tokens, key, ids).toDF("doc_id", "ids")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(by_batch(run), "doc_id long, text string").withColumnRenamed("doc_id", key)
