"""Toxic spans by a linear-chain conditional random field over the words of a text.

Labels mark documents, so the words of the learning documents are labelled first: of a toxic document, those
that (by themselves, or by their beginning or end) are found in many toxic documents and hardly in others.
The field has two states; a word's score is the sum of hashed features of the word, neighbours act
through the transitions.  Forward and backward pass give every word its marginal; the marginals of a document
are aggregated to its score by a logistic function, and runs of likely words are its offending spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import BATCH_ROWS, pick
from stowage.llm.langid import held_out

#: Documents of each label that the field is fitted to at most, those with the smallest hash of their id.
LEARN_DOCS = 2000
#: Longer texts are not used for learning (they are scored whole like all others).
LEARN_CHARS = 20_000
#: A word counts as evidence if its share of toxic documents is so many times that of others, ...
RATIO = 10.0
#: ... and if it explains at least this share of the toxic documents that no better evidence explains.
LEAST_SHARE = 0.003

_BUCKETS = 1 << 16
_WORD = re.compile(r"[^\W_]+")
_BEGINNINGS = (3, 4, 5, 6, 7)  # bytes
_END = 4
_CACHE = 400_000  # words whose scores a task remembers

_STEPS, _BATCH_WORDS, _RATE, _DECAY = 80, 150_000, 0.15, 1e-5


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _parts(word: str) -> list[bytes]:
    """What a word is known by: beginnings, its end, and (marked) itself."""
    own = word.encode()
    parts = [own[:n] for n in _BEGINNINGS if n < len(own)]
    if len(own) > _END:
        parts.append(b">" + own[-_END:])
    parts.append(b"=" + own)
    return parts


def _features(word: str) -> list[int]:
    """Buckets of the parts of a word; bucket 0 is in every word."""
    return [0, *[1 + zlib.crc32(p) % (_BUCKETS - 1) for p in _parts(word)]]


@dataclass
class Model:
    """``weights`` of features, scores of transitions (from, to) and of the first state, logistic terms."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_BUCKETS, np.float64))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    logistic: np.ndarray = field(default_factory=lambda: np.array([-math.inf, 0.0, 0.0]))


# --- the chain ------------------------------------------------------------------------------


def _chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a x[t-1] + b) / (c x[t-1] + d) with x[-1] = 1, for all t.

    The sequence is cut into about sqrt(n) pieces; the maps of a piece are multiplied for all pieces at once,
    pieces are joined one by one, then all pieces are walked at once.
    """
    n = len(a)
    if n == 0:
        return np.empty(0)
    length = max(1, math.isqrt(n))
    pieces = -(-n // length)
    pad = pieces * length - n

    def cut(values: np.ndarray, fill: float) -> np.ndarray:
        filled = np.concatenate([values, np.full(pad, fill)]) if pad else values
        return np.ascontiguousarray(filled.reshape(pieces, length).T)

    a, b, c, d = cut(a, 1.0), cut(b, 0.0), cut(c, 0.0), cut(d, 1.0)
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, length):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    first = np.empty(pieces)
    x = 1.0
    for i, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        first[i] = x
        x = (p1 * x + q1) / (r1 * x + s1)
    out = np.empty((length, pieces))
    x = first
    for t in range(length):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def _odds(scores: np.ndarray, opens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state of every word; ``opens`` marks first words of texts."""
    e = np.exp(np.clip(scores, -30.0, 30.0))
    m = np.exp(model.moves)
    one = np.ones(len(e))
    forward = _chain(
        np.where(opens, 0.0, m[1, 1] * e),
        np.where(opens, math.exp(model.start) * e, m[0, 1] * e),
        np.where(opens, 0.0, m[1, 0]),
        np.where(opens, 1.0, m[0, 0]),
    )
    # from word t to the one before it; behind the last word of a text both states weigh the same
    back = [np.where(opens, 0.0, m[1, 1] * e), np.where(opens, 1.0, m[1, 0])]
    back += [np.where(opens, 0.0, m[0, 1] * e), np.where(opens, one, m[0, 0])]
    behind = _chain(*[v[:0:-1] for v in back])[::-1]
    return forward, np.append(behind, 1.0) if len(e) else behind


def marginals(scores: np.ndarray, opens: np.ndarray, model: Model) -> np.ndarray:
    """Probability of the toxic state of every word."""
    forward, backward = _odds(scores, opens, model)
    both = forward * backward
    return both / (1.0 + both)


# --- learning -------------------------------------------------------------------------------


def learning_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of the sample, and how many usable documents of each label there are.

    Only documents that are not held out, have a text and a label 0 or 1.  Of repeated labels the
    largest counts, of repeated documents one text.
    """
    known = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = pick(docs, "doc_id", "text").filter(F.length("text") <= LEARN_CHARS)
    usable = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    first = [usable.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_DOCS) for t in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # at most 2 * LEARN_DOCS rows
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(one)
    return rows.select("doc_id", "text", "toxic"), counts


def _evidence(sets: list[set[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Parts of words that tell toxic documents, chosen greedily by the documents they explain."""
    bad, good = Counter(), Counter()
    for found, label in zip(sets, toxic):
        (bad if label else good).update(found)
    n_bad, n_good = int(toxic.sum()), int(len(toxic) - toxic.sum())
    least = max(3, LEAST_SHARE * n_bad)
    able = {
        p
        for p, n in bad.items()
        if n >= least and (n + 0.5) / (n_bad + 1) >= RATIO * (good[p] + 0.5) / (n_good + 1)
    }
    where: dict[bytes, set[int]] = {p: set() for p in able}
    for i in np.flatnonzero(toxic):
        for p in sets[i] & able:
            where[p].add(i)
    chosen: set[bytes] = set()
    left = set(np.flatnonzero(toxic).tolist())
    while where:
        # among equals the rarest in other documents, then a stable order
        gain, _, part = max((len(d & left), -good[p], p) for p, d in where.items())
        if gain < least:
            break
        chosen.add(part)
        left -= where.pop(part)
        where = {p: d for p, d in where.items() if len(d & left) >= least}
    return chosen


def fit(texts: list[str], toxic: list[int], counts: dict[int, int] | None = None) -> Model:
    """The field and the logistic function of labelled texts; without both labels nothing is toxic.

    ``counts``: documents by label, of which the texts are a sample.
    """
    order = sorted(set(zip(texts, toxic)))  # copies count once, the order of rows doesn't matter
    toxic = np.array([t for _, t in order], dtype=bool)
    if not toxic.any() or toxic.all():
        rate = 1.0 - 1e-9 if len(toxic) and toxic.all() else 0.0
        model = Model()
        model.logistic[0] = math.log(rate / (1 - rate)) if rate else -math.inf
        return model
    tokens = [words(t) for t, _ in order]
    known: dict[str, list[bytes]] = {}
    for row in tokens:
        for w in row:
            if w not in known:
                known[w] = _parts(w)
    chosen = _evidence([{p for w in set(row) for p in known[w]} for row in tokens], toxic)

    number = {w: i for i, w in enumerate(known)}
    marked = np.array([any(p in chosen for p in parts) for parts in known.values()], dtype=bool)
    lists = [_features(w) for w in known]
    flat = np.array([f for fs in lists for f in fs], dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(fs) for fs in lists])
    ids = np.array([number[w] for row in tokens for w in row], dtype=np.int64)
    sizes = np.array([len(row) for row in tokens])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(tokens)), sizes)
    truth = (marked[ids] & toxic[doc]).astype(np.float64)
    opens = np.zeros(len(ids), dtype=bool)
    opens[(ends - sizes)[sizes > 0]] = True

    model = _train(ids, truth, opens, doc, flat, owner, len(known))
    scores = np.bincount(owner, model.weights[flat], len(known))
    found = marginals(scores[ids], opens, model)
    weight = np.ones(len(toxic))
    if counts and all(counts.get(label) for label in (0, 1)):
        for label in (False, True):
            weight[toxic == label] = counts[int(label)] / (toxic == label).sum()
    model.logistic = _logistic(_aggregate(found, sizes), toxic, weight)
    return model


def _train(ids, truth, opens, doc, flat, owner, n_words) -> Model:
    """Adam on the log likelihood, a slice of the documents a step."""
    model = Model()
    model.weights[0] = -4.0
    starts = np.flatnonzero(opens)
    cuts, low = [], 0
    for s in [*starts[1:].tolist(), len(ids)]:
        if s - low >= _BATCH_WORDS or s == len(ids):
            cuts.append((low, s))
            low = s
    used = np.unique(flat)
    params = np.zeros(len(used) + 5)
    params[0] = model.weights[0]
    mean, square = np.zeros_like(params), np.zeros_like(params)
    slot = np.searchsorted(used, flat)
    rng = np.random.default_rng(0)
    turn = rng.permutation(len(cuts))
    for step in range(1, _STEPS + 1):
        low, high = cuts[turn[step % len(cuts)]]
        i, y, o = ids[low:high], truth[low:high], opens[low:high]
        model.weights[used] = params[:-5]
        model.moves = params[-5:-1].reshape(2, 2)
        model.start = params[-1]
        scores = np.bincount(owner, model.weights[flat], n_words)
        forward, backward = _odds(scores[i], o, model)
        p = forward * backward / (1.0 + forward * backward)
        by_word = np.bincount(i, p - y, n_words)
        grad = np.empty_like(params)
        grad[:-5] = np.bincount(slot, by_word[owner], len(used))
        # pairs of neighbours: from the forward odds before and the backward odds at a word
        at = np.flatnonzero(~o)
        at = at[at > 0]
        f, e = forward[at - 1], np.exp(np.clip(scores[i][at], -30, 30)) * backward[at]
        m = np.exp(model.moves)
        joint = np.stack([np.broadcast_to(m[0, 0], f.shape), m[0, 1] * e, m[1, 0] * f, m[1, 1] * f * e])
        joint /= joint.sum(axis=0)
        pair = (2 * y[at - 1] + y[at]).astype(int)
        grad[-5:-1] = joint.sum(axis=1) - np.bincount(pair, minlength=4)
        grad[-1] = (p - y)[o].sum()
        grad /= len(i)
        grad += _DECAY * params
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        rate = _RATE * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        params -= rate * mean / (np.sqrt(square) + 1e-10)
    model.weights[used] = params[:-5]
    model.moves, model.start = params[-5:-1].reshape(2, 2).copy(), float(params[-1])
    return model


def _aggregate(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: one, the largest marginal, and the logarithm of the number of likely words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    likely = np.bincount(doc, np.where(found >= 0.5, found, 0.0), len(sizes))
    most = np.zeros(len(sizes))
    filled = sizes > 0
    if filled.any():
        most[filled] = np.maximum.reduceat(found, (np.cumsum(sizes) - sizes)[filled])
    return np.stack([np.ones(len(sizes)), most, np.log1p(likely)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; terms but the first are not negative."""
    free = [0, 1, 2]
    while True:
        terms = np.zeros(3)
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ terms, -30, 30)))
            g = x[:, free].T @ (weight * (p - y)) + 0.1 * terms[free]
            h = (x[:, free] * (weight * p * (1 - p))[:, None]).T @ x[:, free] + 0.1 * np.eye(len(free))
            terms[free] -= np.linalg.solve(h, g)
        below = [j for j in free if j and terms[j] < 0]
        if not below:
            return terms
        free = [j for j in free if j not in below]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents that are not held out; see ``learning_rows``."""
    rows, counts = learning_rows(docs, labels)
    sample = rows.collect()  # at most 2 * LEARN_DOCS texts of at most LEARN_CHARS characters
    return fit([r.text for r in sample], [r.toxic for r in sample], counts)


# --- scoring --------------------------------------------------------------------------------


class Scorer:
    """Scores of words, remembered, and of texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.weights = model.weights.tolist()

    def word(self, word: str) -> float:
        score = self.known.get(word)
        if score is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            score = self.known[word] = sum([self.weights[f] for f in _features(word)])
        return score

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score and spans (start, end in characters, largest marginal) of every text."""
        tokens = [words(t) for t in texts]
        sizes = np.array([len(row) for row in tokens], dtype=np.int64)
        scores = np.array([self.word(w) for row in tokens for w in row], dtype=np.float64)
        ends = np.cumsum(sizes)
        opens = np.zeros(len(scores), dtype=bool)
        opens[(ends - sizes)[sizes > 0]] = True
        found = marginals(scores, opens, self.model)
        terms = self.model.logistic
        x = _aggregate(found, sizes)
        margin = terms[0] + x[:, 1:] @ terms[1:]
        with np.errstate(over="ignore"):
            result = 1.0 / (1.0 + np.exp(-margin))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        likely = np.flatnonzero(found >= 0.5)
        for i in np.unique(np.searchsorted(ends, likely, side="right")):
            spans[i] = _spans(texts[i], found[ends[i] - sizes[i] : ends[i]])
        return result, spans


def _spans(text: str, found: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of words that are likelier toxic than not."""
    out: list[tuple[int, int, float]] = []
    last = -2
    places = list(_WORD.finditer(text))
    for i in np.flatnonzero(found >= 0.5):
        start, end = places[i].span()
        p = float(found[i])
        if i == last + 1 and out:
            start, p = out[-1][0], max(out[-1][2], p)
            out.pop()
        out.append((start, end, p))
        last = i
    return out


_SCORED = "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every row of ``docs``; only its text is looked at.

    Null and empty texts and texts without a word have no spans and the score of a text without a toxic
    word.  Long texts are scored whole.  Repeated rows get a row each, an empty table none; further
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                scores, spans = scorer.texts(part.column("text").to_pylist())
                spans = [[{"start": s, "end": e, "p": p} for s, e, p in row] for row in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.array(spans, span)],
                    ["doc_id", "score", "spans"],
                )

    return pick(docs, "doc_id", "text").mapInArrow(run, _SCORED)
