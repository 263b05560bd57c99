"""Operators on vectors, pages and tokens, and the pipeline."""

import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from stowage.llm import bytebpe, extract, packing, urlrules, vectors

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello, world! It's 12345 o'clock.",
    "",
    None,
    "  spaces\t\ttabs\n\n\nlines  ",
    "Größe, ñandú, 漢字かな, 𝄞 e\u0301 \u00a0 nbsp \u2003 em\x1csep",
    "<|endoftext|> is <|startoftext|> text",
    "x" * 5000,
    "word " * 9000,
    "ΟΔΟΣ ΣΑΣ. İstanbul",
]


def docs(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


def brute_vectors(rows):
    def usable(v):
        return v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if usable(v)}
    links = {i: set() for i, _ in rows}
    for i, x in good.items():
        links[i] = {j for j, y in good.items() if j != i and len(x) == len(y) and x @ y >= 0.9}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("cell", [1024, 8])
def test_vectors_like_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24)) for i in range(60)]
    rows += [(100 + i, rows[0][1] + rng.normal(size=24) * 0.1) for i in range(40)]
    rows += [(200 + i, rows[1][1]) for i in range(10)] + [(220, rows[1][1] * 3)]
    rows = [(i, v.tolist()) for i, v in rows]
    nan = float("nan")
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [nan] * 24), (304, [1.0, None]), (305, [1.0, 0.0]), (306, [2.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    found = vectors.near_duplicates(table, cell=cell, miss=1e-6)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    assert got == brute_vectors(rows)


def test_vectors_nulls_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0])], schema)
    found = vectors.near_duplicates(table).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)]
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_tables_follow_rows():
    few, many = vectors.plan_tables(100, 0.9), vectors.plan_tables(10**9, 0.9)
    assert few[0] < many[0] and few[1] < many[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to all of them right now.</div>
<article><h1>A title</h1><p>First paragraph with &amp; some&nbsp;text,
on two lines and more words to make it long enough.</p><p>Short.<script>var x = "<p>no</p>";</script>
<p><b>Bold <i>nested</b> text</i> goes on and on, with an <a href="#">inline link</a> in it.<br>After a break.
<form><input><button>Send</button></form><ul><li>item one<li>item two</ul>
<section class="comments"><p>A reader wrote a long comment here that must not be in the text at all.</p></section></article>
<aside>Related things</aside><footer>&copy; 2020 Somebody, all rights reserved</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == (
        "A title First paragraph with & some text, on two lines and more words to make it long enough."
        " Short. Bold nested text goes on and on, with an inline link in it. After a break. item one item two"
    )


def test_main_text_without_article():
    blocks = "".join(f"<p>{'words of the story ' * 20}{i}</p>" for i in range(3)) + "<p>End.</p>"
    page = f"<div id=menu><a href=a>A</a></div><div><div class=post>{blocks}</div></div><div>(c) me</div>"
    story = " ".join("words of the story " * 20 + str(i) for i in range(3))
    assert extract.main_text(page) == f"{story} End."


def test_pages(spark):
    long = "<article>" + "<p>many words here</p>" * 20_000
    pages = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p></p>"), (5, "u", "plain &amp"), (5, "u", "plain &amp")]
    pages += [(None, "u", "<article>x</article>"), (6, "u", long), (7, "u", "<![if x]><article>a < b</article>")]
    rows = [(i, u, h, "t") for i, u, h in pages]
    found = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = found.collect()
    assert [(r.page_id, r.url) for r in got] == [p[:2] for p in pages]
    assert [r.text for r in got[1:7]] == ["", "", "", "plain &", "plain &", "x"]
    assert got[7].text == " ".join(["many words here"] * 20_000) and got[8].text == "a < b"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    found = packing.pack(docs(spark, TEXTS * 3), TOKENIZER, ids=True).toPandas()
    tool = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(TEXTS * 3):
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = found[found.doc_id == i].sort_values("start")
        assert b"".join(pieces.ids) == ids.tobytes() and (pieces.doc_tokens == len(ids)).all()
        assert (pieces.length.cumsum() - pieces.length == pieces.start).all()
        assert all(zlib.crc32(x) == c for x, c in zip(pieces.ids, pieces.ids_crc32, strict=True))
    found = found.sort_values(["sequence_id", "offset"])
    assert (found.groupby("sequence_id").length.cumsum() - found.length == found.offset).all()
    assert found.groupby("sequence_id").length.sum().max() <= 4096
    assert sorted(found.sequence_id.unique()) == list(range(found.sequence_id.nunique()))
    assert found.doc_id.isna().sum() == 1
    assert packing.pack(docs(spark, TEXTS).limit(0), TOKENIZER).count() == 0


def test_words_are_encoded_as_by_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_CACHE_WORDS", 50)
    tool, encoder = Tokenizer.from_file(TOKENIZER), packing._Encoder(TOKENIZER)
    rng = np.random.default_rng(5)
    letters = list("abXYZ019'’ sStTrReEvVmMlLdD.,!?-_\"\\\0\x0b\x0c\x1c\x1f\x7f\t\n\r \x85 éßÉñÑ«½²œŒÿıŁ\u0301\xadªΣσςİ한😀")
    for length in rng.integers(0, 16, 3000):
        text = "".join(rng.choice(letters, length))
        ids = tool.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes(), text


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    kinds = packing.plan(histogram, 4096)
    used = {}
    for n, held in kinds:
        assert n > 0 and sum(held) <= 4096
        for length in held:
            used[length] = used.get(length, 0) + n
    assert used == histogram
    assert sum(n for n, _ in kinds) * 4096 <= 1.03 * lengths.sum()
    assert packing.plan({}, 4096) == [] and packing.plan({3: 5}, 4) == [(5, [3])]


@pytest.mark.parametrize("longest, pieces", [(4095, 1000), (640, 3000), (60, 3000), (4095, 30)])
def test_the_solution_places_most_pieces(longest, pieces):
    rng = np.random.default_rng(longest)
    lengths = rng.integers(1, longest + 1, pieces)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    kinds, share = packing.plan_and_share(histogram, 4096)
    assert share > 0.5
    assert sum(n for n, _ in kinds) <= -(-lengths.sum() // 4096) * 1.05 + 1


def test_bpe_like_the_rank_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = docs(spark, TEXTS)
    found = bytebpe.encode(table, RANKS, public_tokenizers.PATTERN, ids=True)
    got = {r.doc_id: r for r in found.collect()}
    for i, text in enumerate(TEXTS):
        ids = tool.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    again = bytebpe.decode(found, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.text for r in again} == {**{i: t or "" for i, t in enumerate(TEXTS)}, None: "no id"}
    assert bytebpe.encode(table.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [
        (len(h + p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls_like_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "www.example.net", "/en/x"), ("allow", "org", "")]
    rules += [("block", "a.b.c.org", "/q"), ("allow", "c.org", "/q/long/path"), ("block", "et", "/")]
    hosts = ["example.net", "www.example.net", "WWW.Example.NET", "net", "x-net", "a.b.c.org", "c.org", "d.c.org", "e.com", "a.net:80", ""]
    paths = ["", "/", "/en/", "/en/x/y?u=/q", "/q#x", "/q/long/path/er", "?x=/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] * 3 + [None, "", "no scheme", "://", "a://b://c/d"]
    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(None, "http://net/", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for size in (10, 20_000):
        found = urlrules.judge(pages, table, range_rows=size).collect()
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
        assert len(found) == len(rows)
        assert got == {i: brute_judge(u, rules) for i, u, _ in rows}
    assert urlrules.judge(pages, table.limit(0)).filter("verdict <> 'allow'").isEmpty()
    assert urlrules.judge(pages.limit(0), table).count() == 0


def test_pipeline(spark, tmp_path):
    english = [f"the {w} and the house of {w} was not in that place with this one {i}" for i, w in enumerate(["cat", "dog", "sun", "sea"] * 4)]
    rows = [(i, t + "\nA line of " + t[::-1], "en") for i, t in enumerate(english)]
    rows += [(50, rows[0][1], "en"), (51, "123 456", "en"), (52, None, None), (53, "", "en"), (None, "the last one of the cats", "en")]
    table = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"})
    table["source"], table["n_chars"], table["lang_pred"] = "s", 1, "x"
    table.to_parquet(tmp_path / "documents.parquet")
    found = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = found
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == found.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and not ids & {50, 51, 52, 53} and 0 in ids
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_pipeline_drops_lines_edited_in_a_few_words(spark):
    line = [f"w{i}" for i in range(40)]
    edited = ["x0", "x1", "x2", "x3", *line[4:]]  # 36 of 44 words, 0.82
    other = [*(f"y{i}" for i in range(8)), *line[8:]]  # 32 of 48 words, 0.67
    rows = [(1, " ".join(line)), (2, " ".join(edited) + "\nits own"), (3, " ".join(other))]
    found = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "its own", 3: rows[2][1]}


def test_pipeline_rejects_noise_and_languages_not_learned(spark):
    random = np.random.default_rng(7)
    english = "the and of to in that was with this from they have been there which would their house people were".split()
    german = "der die und nicht in dem haus mit den kindern ist auch eine werden wurde sich noch nach bei aus".split()
    rows = [(i, " ".join(random.choice(german if i % 2 else english, 60)), "de" if i % 2 else "en") for i in range(300)]
    letters = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)]
    rows += [(1000, " ".join(letters), None), (1001, base64.b64encode(random.bytes(300)).decode(), None)]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem"
    rows += [(1002, f"{polish} i sumieniem i powinni postępować wobec innych w duchu braterstwa", None)]
    rows += [(1003, "asdf jkl; sdfkj lksjdf kjsdf lkjsd fkjlsd flkjs dfkj sdlfkj skdjf lskdjf lksdjf lksjdf", None)]
    rows += [(1004, "все люди рождаются свободными и равными в своем достоинстве и правах", None)]
    # noise that bears the name of a language does not lower the floor
    noisy = next(i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows += [(noisy, " ".join(letters[::-1]), "en")]
    found = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in found.collect()) == list(range(300))


STORY = "".join(f"<p>{'words of the story ' * 12}{i}</p>" for i in range(3))
TOLD = " ".join("words of the story " * 12 + str(i) for i in range(3))
MENU = "<div class=menu><a href=a>Home</a> <a href=b>More</a></div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="container has-sidebar">{MENU}<article>{STORY}</article></div>', TOLD),
        (f'<form id="aspnetForm"><div id="page" class="no-sidebar">{MENU}<main>{STORY}</main></div></form>', TOLD),
        (f'<div class="page-with-ads"><article>{STORY}</article><div class="ad">Buy this now.</div></div>', TOLD),
        (f'<article><p>Head.</p><div class="social-history">{STORY}</div></article>', f"Head. {TOLD}"),
        (f'<article>{STORY}<div class="related"><a href=a>Other</a> <a href=b>Third</a></div></article>', TOLD),
        (f'<article>{STORY}<p>It is <math><mi>x</mi></math> here.</p></article>', f"{TOLD} It is x here."),
        (f'<div class="no-sidebar">{MENU}<div>{STORY}</div></div>', TOLD),
        (f'<form id="aspnetForm">{MENU}{STORY}</form>', TOLD),
        (f'<div class="no-ads"><article>{STORY}</article></div><div class="comments"><article>{STORY}more</article></div>', TOLD),
        (f'<div class="has-sidebar"><main>{STORY}</main><div class="related"><article>Short teaser.</article></div></div>', TOLD),
        (f"<div><div>{STORY}</div><div>Yes.</div>{MENU}<div>{STORY}</div></div>", f"{TOLD} Yes. {TOLD}"),
    ],
)
def test_main_text_in_labelled_elements(page, text):
    assert extract.main_text(f"<body>{page}<footer>(c) me</footer></body>") == text
