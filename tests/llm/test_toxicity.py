"""The random field against sums over all labellings, and its accuracy on planted words."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import langid, toxicity

PLAIN = [a + b for a in ("ta", "lo", "mi", "ren", "so") for b in ("ka", "per", "nu", "dol", "vi", "sta")]
BAD = ["grubel", "grubol", "snarf", "snarfel"]


def sample(n, seed=1, bad=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < bad
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_marginals_like_all_labellings():
    rng = np.random.default_rng(2)
    model = toxicity.Model(moves=rng.normal(size=(2, 2)), start=0.7)
    sizes = [1, 4, 7, 2]
    scores = rng.normal(size=sum(sizes)) * 2
    opens = np.zeros(sum(sizes), dtype=bool)
    opens[[0, 1, 5, 12]] = True
    expected, at = [], 0
    for n in sizes:
        weight, hit = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            total = model.start * y[0] + sum(scores[at + t] * y[t] for t in range(n))
            w = np.exp(total + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            hit += w * np.array(y)
        expected += (hit / weight).tolist()
        at += n
    assert np.allclose(toxicity.marginals(scores, opens, model), expected)
    assert len(toxicity.marginals(np.empty(0), np.empty(0, bool), model)) == 0


def test_scores_do_not_depend_on_neighbours_in_a_batch():
    rows = sample(400)
    scorer = toxicity.Scorer(toxicity.fit([r[1] for r in rows], [r[2] for r in rows]))
    texts = [r[1] for r in sample(60, 9)] + ["", None, "snarf", "?!", "tadol " * 30_000]
    together, spans = scorer.texts(texts)
    for text, score, span in zip(texts, together, spans):
        alone, own = scorer.texts([text])
        assert np.isclose(alone[0], score, atol=1e-9) and [s[:2] for s in own[0]] == [s[:2] for s in span]


def test_learned_from_documents_that_are_not_held_out(spark):
    rows = sample(900)
    docs = spark.createDataFrame(
        [(i, t, "en") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "Snarf nu.", "x")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(1, None, 0), (9999, 1, 0)], "doc_id long, toxic int, text int")
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs, model).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    text = {i: t for i, t, _ in rows}
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in found if r.doc_id in truth and r.out]
    assert len(right) > 150 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found)
    for r in found:
        for span in r.spans or []:
            if r.doc_id in text and truth[r.doc_id]:
                marked = text[r.doc_id][span.start : span.end].lower()
                assert any(w.startswith(("grub", "snarf")) for w in marked.split()), marked
    clean = {r.doc_id: r.score for r in found if r.doc_id in (5000, 5001)}
    assert len(set(clean.values())) == 1 and max(clean.values()) < 0.3
    # labels of held-out documents are never looked at
    flipped = labels.withColumn("toxic", F.col("toxic").bitwiseXOR(langid.held_out(F.col("doc_id")).cast("int")))
    again = toxicity.learn(docs, flipped)
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.logistic, model.logistic)


def test_repeats_ties_and_empty_tables(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(*empty)
    assert toxicity.score(empty[0], model).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None)], schema)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    rows = sample(200)
    docs = spark.createDataFrame([r[:2] for r in rows] * 2 + [(1, "other text")], schema)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] * 2 + [(r[0], 0) for r in rows], "doc_id long, toxic int")
    sampled, counts = toxicity.learning_rows(docs, labels)
    assert sampled.count() == sampled.select("doc_id").distinct().count() == sum(counts.values())
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 401


def test_copies_and_order_of_learning_texts_do_not_matter():
    rows = sample(150)
    once = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    twice = toxicity.fit([r[1] for r in rows[::-1]] * 2, [r[2] for r in rows[::-1]] * 2)
    assert np.array_equal(once.weights, twice.weights)
