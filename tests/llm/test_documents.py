"""Operators on documents: near duplicates, lines, language, shards, fingerprints."""

import hashlib
import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.llm import fingerprints, langid, linedup, minhash, sharding
from stowage.operators import scratch

SCHEMA = "doc_id long, text string, lang string, component_id string, DOC_ID string"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, rows):
    """Documents with two columns whose names clash with results and, but for case, with the id."""
    return spark.createDataFrame([(i, t, "xx", "c", "d") for i, t in rows], SCHEMA)


def collected(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: find(i) for i in ids}, sets


def near_copies():
    base = " ".join(WORDS[:120])
    rows = [(i, base.replace(f"w{3 * i} ", f"x{i} ")) for i in range(20)]
    rows += [(20 + i, base.replace(f"w{i} ", f"x{i} y{i} z{i} ").replace(f"w{60 + i} ", "")) for i in range(20)]
    rows += [(40 + i, " ".join(WORDS[i * 7 : i * 7 + 30])) for i in range(20)]
    rows += [(70, ""), (71, None), (72, " \n\t"), (73, "One two"), (74, "one\ttwo"), (75, "one two three")]
    rows += [(80, " ".join(WORDS) * 300), (81, " ".join(WORDS) * 300 + " end")]
    return rows


@pytest.mark.parametrize("cell", [1024, 4])
def test_near_duplicates_like_brute_force(spark, cell):
    rows = near_copies()
    root, sets = brute_components(rows)
    found = minhash.near_duplicates(table(spark, rows), cell=cell)
    assert found.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    expected = [(i, len(sets[i]), root[i], root[i] == i) for i, _ in rows]
    assert collected(found, *found.columns[:4]) == sorted(expected, key=repr)


def test_near_duplicates_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (None, None)]
    found = minhash.near_duplicates(table(spark, rows))
    assert collected(found, "doc_id", "component_id", "kept") == sorted(
        [(None, None, False), (3, 2, False), (3, 2, False), (2, 2, True), (None, None, False)], key=repr
    )
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_posterior_keeps_what_reaches_the_threshold():
    floors = minhash._posterior_floor(0.75, 1e-6, [32, 64, 96, 128])
    assert floors == sorted(floors)
    assert all(f < 0.75 * n for f, n in zip(floors, (32, 64, 96, 128), strict=True))
    assert floors[-1] > 0.5 * 128


def brute_lines(rows, percent):
    lines = [
        (d, p, frozenset(words(line.lower())))
        for d, t in sorted(rows)
        for p, line in enumerate((t or "").split("\n") if t is not None else [])
    ]
    out = []
    for at, (d, p, s) in enumerate(lines):
        gone = any(
            s and e and (100 + percent) * len(s & e) >= percent * (len(s) + len(e)) for _, _, e in lines[:at]
        )
        out.append((d, p, len(s), not gone))
    return out


def line_rows():
    base = WORDS[:30]
    rows = []
    for i in range(25):
        edited = [*base]
        edited[i] = f"x{i}"
        rows.append((i, f"head {i}\n{' '.join(edited)}\n\nHEAD {i}\n" + " ".join(WORDS[i * 5 : i * 5 + 12])))
    rows += [(40, None), (41, ""), (42, " \t "), (43, "a"), (44, "a\nA a\nb"), (45, " ".join(WORDS) * 40)]
    rows += [(46, " ".join(WORDS + ["more"]) * 40)]
    return rows


@pytest.mark.parametrize("percent, first", [(90, 16), (75, 1), (90, 1)])
def test_lines_like_brute_force(spark, monkeypatch, percent, first):
    monkeypatch.setattr(linedup, "FIRST", first)
    rows = line_rows()
    found = linedup.line_decisions(table(spark, rows), percent=percent)
    expected = brute_lines(rows, percent)
    assert collected(found, "doc_id", "line_no", "n_words", "kept") == sorted(expected, key=repr)


def test_lines_of_frequent_words_meet_few_others(spark, monkeypatch):
    """Lines that share many words but are not alike make no pairs and nothing that is set aside."""
    met = []
    save = linedup.save

    def counting(df, label="rows", **facts):
        table = save(df, label, **facts)
        if label == "met":
            met.append(table.count())
        return table

    monkeypatch.setattr(linedup, "save", counting)
    draw = random.Random(7)
    rows = [(i, " ".join(draw.sample(WORDS[:60], 30))) for i in range(400)]
    found = linedup.line_decisions(table(spark, rows), percent=90)
    assert collected(found, "doc_id", "line_no", "n_words", "kept") == sorted(brute_lines(rows, 90), key=repr)
    assert met[0] < 200


def test_lines_of_many_parts(spark):
    draw = random.Random(7)
    long = [f"w{i}" for i in range(900)]
    rows = [(500 + k, " ".join(long[: 900 - 19 * k] + [f"e{k}x{j}" for j in range(19 * k)])) for k in range(6)]
    rows += [(600 + k, " ".join(draw.sample(long, 855 - k))) for k in range(4)]
    found = linedup.line_decisions(table(spark, rows), percent=90)
    assert collected(found, "doc_id", "line_no", "n_words", "kept") == sorted(brute_lines(rows, 90), key=repr)


def test_parts_of_a_set(spark):
    """No more parts than a pair can differ in words and one; a word decides on one part of a class."""
    long = [f"w{i}" for i in range(300)]
    docs = linedup._identified(table(spark, [(1, " ".join(long)), (2, " ".join(long[1:])), (3, "")]), "doc_id", "text")
    found = {r.doc: r for r in linedup._with_parts(docs, 90).select("doc", "n", "classes", "signs").collect()}
    most = [math.ceil(linedup.RATIO ** (c + 1)) for c in found[1].classes]
    parts = [10 * (m + m * 100 // 90) // 190 + 1 for m in most]
    assert found[1].n == 300 and len(found[1].signs) == len(set(found[1].signs)) == sum(parts)
    assert len(set(found[1].signs) - set(found[2].signs)) <= len(parts)
    assert found[3].n == 0 and not found[3].signs


def test_lines_below_parts_set_no_postings_aside(spark, monkeypatch):
    """Lines that share rare words but are not alike are dropped before their word sets are joined."""
    rows_of = {}
    save = linedup.save

    def counting(df, label="rows", **facts):
        table = save(df, label, **facts)
        rows_of[label] = rows_of.get(label, 0) + table.count()
        return table

    monkeypatch.setattr(linedup, "save", counting)
    draw = random.Random(7)
    rows = [(i, " ".join(draw.sample([f"w{k}" for k in range(220)], 150))) for i in range(150)]
    found = linedup.line_decisions(table(spark, rows), percent=75)
    assert collected(found, "doc_id", "line_no", "n_words", "kept") == sorted(brute_lines(rows, 75), key=repr)
    assert "met" not in rows_of and rows_of["pairs"] > 0 and rows_of["near"] < rows_of["pairs"]


def test_lines_of_a_group_and_long_lines_make_few_pairs(spark, monkeypatch):
    """A line of a large group of near copies meets few of it, and long lines that are not alike meet none."""
    pairs = []
    save = linedup.save

    def counting(df, label="rows", **facts):
        table = save(df, label, **facts)
        if label == "pairs":
            pairs.append(table.count())
        return table

    monkeypatch.setattr(linedup, "save", counting)
    draw = random.Random(7)
    base = [f"c{k}" for k in range(20)]
    rows = [(i, " ".join([*base[: i % 20], f"x{i}", *base[i % 20 + 1 :]])) for i in range(150)]
    rows += [(1000 + i, " ".join(draw.sample([f"w{k}" for k in range(400)], 250))) for i in range(60)]
    found = linedup.line_decisions(table(spark, rows), percent=75)
    assert collected(found, "doc_id", "line_no", "n_words", "kept") == sorted(brute_lines(rows, 75), key=repr)
    assert 0 < sum(pairs) < 10 * 150


def test_tables_of_a_step_go(spark):
    kept = []

    def make():
        kept.append(scratch.save(spark.range(5), "inner"))
        return kept[0].filter("id > 1")

    made = scratch.save_step(spark, make, "outer")
    assert made.count() == 3
    folder = spark._jvm.org.apache.hadoop.fs.Path(getattr(kept[0], scratch._FOLDER))
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def test_lines_leave_documents(spark):
    rows = [(1, "one two\nthree"), (2, "Two one"), (3, "three\n\nfour"), (4, None), (5, ""), (2, "Two one"), (None, "four")]
    docs = table(spark, rows)
    found = linedup.dedup_lines(docs)
    assert found.columns == docs.columns
    by_place = found.toDF(*[f"c{i}" for i in range(5)])
    assert collected(by_place, "c0", "c1", "c4") == sorted(
        [(1, "one two\nthree", "d"), (3, "\nfour", "d"), (4, None, "d"), (5, "", "d")], key=repr
    )
    assert linedup.dedup_lines(table(spark, [])).count() == 0


def test_language(spark):
    english = "the cat and the dog went to the house with this and that"
    german = "der hund und die katze sind nicht in dem haus mit den kindern"
    rows = [(i, (english if i % 2 else german) + f" {i}", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert sorted(profiles) == ["de", "en"] and all(len(set(p)) == len(p) for p in profiles.values())
    texts = [(1, "The dog and the cat"), (2, "die katze und der hund"), (3, "123 !!"), (4, ""), (5, None), (5, None)]
    texts += [(None, english * 30_000)]
    tried = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, lang_pred string")
    found = langid.identify(tried, profiles)
    assert found.columns == ["doc_id", "text", "lang_pred", "lang_pred", "score"]
    rows = [(r[0], r[3], r[4]) for r in found.collect()]
    assert [(i, lang) for i, lang, _ in rows] == [
        (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "und"), (None, "en")
    ]
    assert all(0 <= s <= 1 for *_, s in rows) and rows[2][2] == 0
    empty = langid.learn(docs.limit(0))
    assert empty == {} and langid.identify(tried, empty).filter("score > 0").isEmpty()


def test_languages_and_floors_come_from_all_texts(spark):
    """A letter that only one text has is in the profile, whichever text it is; odd scores count by their share."""
    rows = [(i, chr(0x4E00 + i), "zh") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~langid.held_out(F.col("doc_id")))
    assert docs.count() > 2000
    assert len(langid.learn(docs, profile=1 << 20, longest=1)["zh"]) == docs.count()

    def floor(odd, usual):
        scores = [0.6] * odd + [0.8] * usual
        found = spark.createDataFrame([("word", "en", s) for s in scores] + [("", "und", 0.0)], "text string, lang_pred string, score double")
        return langid.least_scores(found)[None]

    assert floor(3, 2997) == pytest.approx(0.9 * 0.8) and floor(4, 2996) == pytest.approx(0.9 * 0.6)
    assert floor(1, 900) == pytest.approx(0.9 * 0.6) and floor(1, 98) == pytest.approx(0.4) and floor(0, 0) == 0


def test_slices_of_long_texts_count_like_one(monkeypatch):
    text = "Größe und Maß, ¿qué tal? " * 50
    whole = langid._grams(text, 3)
    monkeypatch.setattr(langid, "_SLICE", 64)
    parts = langid._grams(text, 3)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_language_learns_nothing_from_held_out(spark):
    ids = spark.range(400).withColumn("out", langid.held_out(F.col("id")))
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in ids.collect())


def test_shards(spark):
    rows = [(i, "é" * (i % 50)) for i in range(3000)] + [(7, "same")] * 1500 + [(None, None)] * 500
    found = sharding.shard(table(spark, rows), shards=7, keep=("text",)).toPandas()
    assert len(found) == 5000 and set(found.shard) == set(range(7))
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * (0.001 * sizes.sum() / 7 + found["size"].max())
    for _, slots in found.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    for text, size, crc in zip(found.text, found["size"], found.text_crc32, strict=True):
        raw = (text or "").encode()
        assert size == len(raw) + 16 and crc == zlib.crc32(raw)
    assert found.law.eq("bytes").all() and found.grown_shard.isna().all()
    assert sharding.shard(table(spark, [])).count() == 0
    assert sharding.shard(table(spark, [(1, "one")])).count() == 1


def test_shards_written(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}") for i in range(100)])
    sharding.write_shards(sharding.shard(docs, shards=3, keep=("text",)), str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.select("shard").distinct().count() == 3 and again.count() == 100


def brute_fingerprints(rows):
    ordered = sorted(rows)
    out = {}
    for at, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        cut = len(text) - len(text) // 2
        edited = text[:cut] + following[: len(text) // 2]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_fingerprints(spark):
    rows = [(i, f"Zeile {i} 𝄞é " * (i + 1)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, "long " * 50_000)]
    found = fingerprints.fingerprints(table(spark, rows), range_rows=7)
    got = {r.doc_id: r for r in found.collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == brute_fingerprints(rows)
    assert got[102].fingerprint == got[5].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in rows})
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got.values())
    ordered = sorted(rows)
    for at, (i, text) in enumerate(ordered):
        x, y = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        start = len(os.path.commonprefix([x, y]))
        end = len(os.path.commonprefix([x[::-1], y[::-1]]))
        assert (got[i].start_next, got[i].end_next) == (start, end)
        exact = 1.0 if x == y else min(start + end, len(x), len(y)) / max(len(x), len(y))
        low = 2 * max(map(fingerprints._stride, (len(x), len(y)))) / max(len(x), len(y), 1)
        assert exact - low <= got[i].near_next <= exact + 1e-12
    assert got[100].near_next == 1.0 and got[103].near_edited == pytest.approx(0.5, abs=0.04)


def test_fingerprints_small_tables(spark):
    assert fingerprints.fingerprints(table(spark, [])).count() == 0
    one = fingerprints.fingerprints(table(spark, [(None, "abcd")])).first()
    assert (one.doc_id, one.edited_sha256) == (None, hashlib.sha256(b"abab").hexdigest())
    assert fingerprints.fingerprints(table(spark, [(1, "same")] * 3)).count() == 3


def test_spans_and_extensions():
    x = fingerprints.Prefixes(fingerprints.code_points("abracadabra"))
    y = fingerprints.Prefixes(fingerprints.code_points("cadabrax"))
    assert fingerprints.same_span(x, 4, y, 0, 7) and not fingerprints.same_span(x, 0, y, 0, 1)
    assert fingerprints.common_extension(x, 4, y, 0) == 7
    assert fingerprints.common_extension(x, 0, x, 7) == 4
