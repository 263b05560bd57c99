"""Cases at the edge of the contracts of the queries."""

import pandas as pd
import pytest

import corpus_pipeline
from stowage.llm import extract, langid, minhash, sharding, vectors

P = "A long paragraph of running text that says something about the matter at hand, and goes on for a while. "
LINKS = "<a href=1>Other</a> <a href=2>Story</a>"


@pytest.mark.parametrize(
    "page, text",
    [
        # with an article, dense text outside of it is out
        (f"<nav>{LINKS}</nav><main><p>{P}1</p><p>{P}2</p></main><div>{P}</div>", f"{P}1 {P}2"),
        # without one, a table between paragraphs is in
        (f"<div><p>{P}1</p><table><tr><td>12</td><td>13</td></tr></table><p>{P}2</p></div>", f"{P}1 12 13 {P}2"),
        # a label word in a longer name says little, a list of links is none of the text
        (
            f'<article><p>{P}1</p><div id="share-price">Price: 12 EUR</div><p>{P}2</p><div class="share">{LINKS}</div></article>',
            f"{P}1 Price: 12 EUR {P}2",
        ),
        # an open menu ends where the article begins
        (f"<nav><a href=x>Home</a><article><p>{P}1</p></article>", f"{P}1"),
        # an aside in an article counts by its density
        (f"<article><p>{P}1</p><aside><p>{P}2</p></aside><p>{P}3</p><aside>{LINKS}</aside></article>", f"{P}1 {P}2 {P}3"),
        ("<nav><a href=x>Home</a></nav>", ""),
    ],
)
def test_pages(page, text):
    found = extract.main_text(f"<html><body>{page}</body></html>")
    assert found == " ".join(text.split())


def test_no_letter_no_language(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    profiles = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = ["❤️ ☀️", "́", "12 ⃝ 3", "ét the cat"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: (r[2], r[3]) for r in langid.identify(table, profiles).collect()}
    assert [found[i] for i in range(3)] == [("und", 0.0)] * 3 and found[3][0] != "und"


def test_shards_and_slots_do_not_depend_on_files(spark):
    rows = [(i, "word " * (i % 60)) for i in range(1500)] + [(7, f"text {i}") for i in range(700)]
    rows += [(None, f"other {i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")

    def placed(docs):
        found = sharding.shard(docs, shards=5, keep=("text",)).collect()
        return sorted(((r.doc_id, r.text, r.shard, r.slot) for r in found), key=repr)

    first = placed(table.repartition(3))
    assert first == placed(table.repartition(7, "text"))
    assert len({(s, at) for _, _, s, at in first}) == len(rows)


def test_texts_that_share_an_id_go_by_their_own_group(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:58], "x", "y"]
    other = [f"v{i}" for i in range(60)]
    rows = [(1, base), (5, near), (5, other), (5, other), (6, [*other, "more"]), (8, base[::-1]), (8, [*base[::-1], "z"])]
    docs = spark.createDataFrame([(i, " ".join(w), "e") for i, w in rows], "doc_id long, text string, kept string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted((r[0], r[1].split()[0], len(r[1].split())) for r in kept.collect())
    assert found[:2] == [(1, "w0", 60), (5, "v0", 60)] and len(found) == 3 and found[2][0] == 8
    groups = minhash.near_duplicates(docs).collect()
    assert len(groups) == 7 and len({r.group_id for r in groups}) == 3


def test_vectors_of_several_lengths_in_one_bucket():
    import numpy as np
    import pyarrow as pa

    unit = np.ones(4) / 2, np.ones(9) / 3
    vecs = [unit[0].tobytes(), unit[1].tobytes(), unit[0].tobytes(), unit[1].tobytes()]
    batch = pa.RecordBatch.from_pydict(
        {
            "t": pa.array([0] * 4, pa.int32()), "bucket": pa.array([5] * 4, pa.int64()),
            "_i": pa.array([0] * 4, pa.int32()), "_j": pa.array([0] * 4, pa.int32()),
            "_own": pa.array([0] * 4, pa.int32()), "rid": pa.array([10, 11, 12, 13], pa.int64()),
            "copies": pa.array([1] * 4, pa.int64()), "vec": pa.array(vecs, pa.binary()),
        }
    )
    (out,) = vectors._meet([batch], 0.9, 2, 3, 1.0)
    links = [(a, b) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()) if b is not None]
    assert sorted(map(sorted, links)) == [[10, 12], [11, 13]]


def test_pipeline_of_no_documents(spark, tmp_path):
    types = {"doc_id": "Int64", "text": "string", "lang": "string", "source": "string", "n_chars": "Int64"}
    pd.DataFrame({c: [] for c in types}).astype(types).to_parquet(tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_recall_of_planted_vectors(spark):
    """At the setting of the query; the given vectors hold no pair from 0.9 on."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=(700, 64))
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = rng.uniform(0.9, 0.99, 700)
    near = base * cosine[:, None] + noise * np.sqrt(1 - cosine**2)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    linked = {r.vec_id for r in found.collect() if r.n_links}
    every = np.array([v for _, v in rows])
    truth = {int(i) for i in np.flatnonzero((np.triu(every @ every.T, 1) + np.tril(every @ every.T, -1) >= 0.9).any(axis=1))}
    assert linked <= truth and len(linked) >= 0.98 * len(truth)
