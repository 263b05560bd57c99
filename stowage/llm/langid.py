"""Language by rank-order profiles: out-of-place distance of the most frequent n-grams."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import by_batch, pick

#: n-grams of one to this many characters (letters, and one space between words).
LONGEST = 3
#: Length of a profile.
PROFILE = 400
#: Learning texts of like length from which their lowest score says something.
FLOOR_DOCS = 100
#: One in so many learning texts of a group may lie below its lowest score.
FLOOR_SHARE = 1000
#: Parts of the range of scores in which they are counted.
SCORE_PARTS = 1000

_SPACE = 32
_SLICE = 1 << 20
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, which is part of a word, else 0."""
    global _letters
    if _letters is None:
        kinds = {"L": 2, "M": 1}
        _letters = np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.int8)
    return _letters


def _grams(text: str | None, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into integers, and how often each occurs.

    The text is lower-cased; all that is no letter or mark parts words.  Long texts are
    counted slice by slice, slices overlap by what an n-gram needs.
    """
    empty = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return empty
    letter = _letter_table()
    parts = []
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kind = letter[codes]
    if not (kind == 2).any():
        return empty
    is_letter = kind > 0
    codes = np.where(is_letter, codes, _SPACE).astype(np.int64)
    codes = codes[is_letter | np.concatenate([[True], is_letter[:-1]])]
    first, last = int(codes[0] == _SPACE), len(codes) - int(codes[-1] == _SPACE)
    codes = np.concatenate([[_SPACE], codes[first:last], [_SPACE]])
    for start in range(0, len(codes), _SLICE):
        packed = []
        for n in range(1, longest + 1):
            part = codes[start : start + _SLICE + n - 1]
            if len(part) < n:
                continue
            code = np.zeros(len(part) - n + 1, np.int64)
            for i in range(n):
                code = (code << 21) | part[i : len(part) - n + 1 + i]
            packed.append(code[code != _SPACE])
        parts.append(np.unique(np.concatenate(packed), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
    return grams, counts


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))[:size]]


def _count_batch(batch: pa.RecordBatch, longest: int) -> pa.RecordBatch:
    """n-gram counts of a batch of (lang, text), summed by language."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        held.setdefault(lang, []).append(_grams(text, longest))
    langs, all_grams, all_counts = [], [], []
    for lang, parts in held.items():
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(grams), np.int64)
        np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
        langs += [lang] * len(grams)
        all_grams.append(grams)
        all_counts.append(counts)
    whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (all_grams, all_counts)]
    return pa.record_batch(
        [pa.array(langs, pa.string()), pa.array(whole[0]), pa.array(whole[1])], ["lang", "gram", "n"]
    )


def held_out(doc_id: Column) -> Column:
    """Documents nothing is learned from: crc32 of the id as text leaves 2 on division by 4.

    A document without an id is not held out; it is not learned from either.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, profile: int = PROFILE, longest: int = LONGEST) -> dict[str, list[int]]:
    """Profile of every language in ``docs`` (doc_id, text, lang): its n-grams by rank.

    Learned from all whole texts that are not held out; ties of n-grams go by the n-gram.  Rows without id,
    language or text are left out; repeated rows count each; an empty table gives no profile.  Only the profiles come
    to the driver: ``profile`` numbers a language.
    """
    docs = pick(docs, "doc_id", "text", "lang")
    return profiles_of(docs.filter(learnable()).select("lang", "text"), profile, longest)


def learnable() -> Column:
    """Rows (doc_id, text, lang) that may be learned from."""
    known = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return known & ~held_out(F.col("doc_id"))


def profiles_of(
    texts: DataFrame, profile: int = PROFILE, longest: int = LONGEST
) -> dict[str, list[int]]:
    """Profile of every language in ``texts`` (lang, text)."""
    counts = texts.mapInArrow(by_batch(_count_batch, longest), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= profile)
    found: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def length_class(text: Column) -> Column:
    """Texts of a class are at most twice as long as one another."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)).cast("double"))).cast("int")


def least_scores(found: DataFrame, length: Column | None = None) -> dict[int | None, float]:
    """The score from which a text counts as one of a learned language, by class of its length.

    ``found`` (text, lang_pred, score) holds all learning texts as ``identify`` sees them; ``length`` is the class of
    their length if it is known without the text.  The score is a tenth below
    the lowest one of them all, or a fifth below the lowest of those of the class and its two neighbours if that is
    higher and they are at least ``FLOOR_DOCS``; None stands for the classes that have no value of their own.
    Below the lowest score of a group lies one in ``FLOOR_SHARE`` of it, so that a few odd texts of a large
    group don't decide; a text below half of the median has no say either (noise that bears the name
    of a language).  Fewer than ``FLOOR_DOCS`` learning texts in all give half of their median.
    Scores are counted, without a sample, in ``SCORE_PARTS`` parts of their range, each with its least score: these
    alone come to the driver.
    """
    length = (length_class(F.col("text")) if length is None else length).alias("c")
    part = F.floor(F.col("score") * SCORE_PARTS).cast("int").alias("part")
    counted = found.filter("lang_pred <> 'und'").select(length, part, "score").groupBy("c", "part")
    counted = counted.agg(F.count("*").alias("n"), F.min("score").alias("least"))
    parts = sorted(tuple(r) for r in counted.select("part", "least", "n", "c").collect())
    total = sum(n for _, _, n, _ in parts)
    if not total:
        return {None: 0.0}

    def nth(group: list[tuple], k: int) -> float:
        """The least score of the part in which the text with k below it lies."""
        for _, least, n, _ in group:
            if k < n:
                return least
            k -= n
        raise IndexError(k)

    def median(group: list[tuple]) -> float:
        return nth(group, sum(n for _, _, n, _ in group) // 2)

    def lowest(group: list[tuple]) -> float:
        half = median(group) / 2
        said = [g for g in group if g[1] >= half]
        return nth(said, sum(n for _, _, n, _ in said) // FLOOR_SHARE)

    if total < FLOOR_DOCS:
        return {None: median(parts) / 2}
    out: dict[int | None, float] = {None: 0.9 * lowest(parts)}
    for c in range(max(p[3] for p in parts) + 2):
        near = [p for p in parts if abs(p[3] - c) <= 1]
        if sum(n for _, _, n, _ in near) >= FLOOR_DOCS:
            out[c] = max(out[None], 0.8 * lowest(near))
    return out


class _Profiles:
    """Profiles as sorted arrays for lookups."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.tables = []
        for lang in self.langs:
            grams = np.array(profiles[lang], np.int64)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def distances(self, top: np.ndarray, most: int) -> list[int]:
        ranks = np.arange(len(top))
        out = []
        for grams, places in self.tables:
            at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
            apart = np.where(grams[at] == top, np.abs(places[at] - ranks), most)
            out.append(int(apart.sum()))
        return out


def _predict(batch: pa.RecordBatch, profiles: _Profiles, size: int, longest: int) -> pa.RecordBatch:
    langs, scores = [], []
    for text in batch.column(1).to_pylist():
        grams, counts = _grams(text, longest)
        if not len(grams) or not profiles.langs:
            langs.append("und")
            scores.append(0.0)
            continue
        top = _top(grams, counts, size)
        apart = profiles.distances(top, size)
        best = int(np.argmin(apart))
        langs.append(profiles.langs[best])
        scores.append(1.0 - apart[best] / (size * len(top)))
    return pa.record_batch(
        [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
        ["_at", "lang_pred", "score"],
    )


def identify(
    docs: DataFrame,
    profiles: dict[str, list[int]],
    text: str = "text",
    profile: int = PROFILE,
    longest: int = LONGEST,
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1) behind them.

    A document's ``profile`` most frequent n-grams are held against every language's; an
    n-gram costs the difference of its ranks, or ``profile`` if the language does not have it.  The
    language with the smallest sum wins, ties go to the first by name; score is 1 less the
    mean cost as a share of the highest.  Null and empty texts and texts without a letter are
    ``und`` with score 0.  Texts may have any length, rows may repeat, an empty table gives no
    rows.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = names.index(text)
    known = _Profiles(profiles)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)

    def run(batches):
        for batch in batches:
            made = _predict(
                pa.record_batch([batch.column(at), batch.column(at)], ["_at", "text"]),
                known,
                profile,
                longest,
            )
            columns = [*batch.columns, made.column(1), made.column(2)]
            yield pa.record_batch(columns, [*batch.schema.names, "lang_pred", "score"])

    found = flat.mapInArrow(run, f"{fields}, lang_pred string, score double")
    return found.toDF(*names, "lang_pred", "score")
