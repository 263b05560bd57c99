"""One query for each operator of this subpackage, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import (
    bytebpe,
    centroids,
    extract,
    fingerprints,
    langid,
    linedup,
    minhash,
    packing,
    sharding,
    toxicity,
    turns,
    urlrules,
    vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Score from which a document is called toxic.
TOXIC = 0.3

#: (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_minhash",
    r"""WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)),
            lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM words WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b USING (s)
        GROUP BY ALL),
    links AS (
        SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * o >= 75 * (p.n + q.n - o)),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
        coalesce(c, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON x = d.doc_id""",
)
def op1_minhash(spark, folder):
    found = minhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_sharding")
def op2_sharding(spark, folder):
    return sharding.shard(_table(spark, folder, "documents"))


@query("op3_language")
def op3_language(spark, folder):
    docs = _table(spark, folder, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    out = langid.held_out(found["doc_id"]).alias("held_out")
    return found.select("doc_id", out, "lang_pred", "score")


@query(
    "op4_embeddings",
    """WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
            AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
    least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, least(coalesce(c, e.vec_id), e.vec_id) AS component_id,
        least(coalesce(c, e.vec_id), e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN least l ON l.x = e.vec_id""",
)
def op4_embeddings(spark, folder):
    return vectors.near_duplicates(_table(spark, folder, "embeddings"))


@query("op5_html_text")
def op5_html_text(spark, folder):
    return extract.extract(_table(spark, folder, "pages"))


@query("op6_packing")
def op6_packing(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, folder, "documents"), path)


@query("op7_fingerprints")
def op7_fingerprints(spark, folder):
    return fingerprints.fingerprints(_table(spark, folder, "documents"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encode(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query(
    "op9_url_rules",
    r"""WITH parts AS (
        SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
        ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    fits AS (
        SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(verdict, len(rh || rp)) AS verdict
        FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        GROUP BY page_id)
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id""",
)
def op9_url_rules(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlrules.judge(_table(spark, folder, "pages"), rules)


#: Lines, their sets of words and the lines that go.
LINES_SQL = r"""lines AS (
        SELECT doc_id, i - 1 AS line_no, list_distinct(list_filter(
            regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w
        FROM (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM {table}))),
    sets AS (
        SELECT list_sort(w) AS w, len(w) AS n, min((doc_id, line_no)) AS f FROM lines WHERE len(w) > 0 GROUP BY ALL),
    like_earlier AS (
        SELECT DISTINCT b.w FROM sets a JOIN sets b ON a.f < b.f AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
        WHERE 190 * len(list_intersect(a.w, b.w)) >= 90 * (a.n + b.n)),
    judged AS (
        SELECT l.doc_id, l.line_no, len(l.w) AS n_words, len(l.w) = 0
            OR (s.f = (l.doc_id, l.line_no) AND e.w IS NULL) AS kept
        FROM lines l LEFT JOIN sets s ON s.w = list_sort(l.w) LEFT JOIN like_earlier e ON e.w = list_sort(l.w))"""


@query(
    "op10_line_dedup",
    "WITH "
    + LINES_SQL.replace("{table}", "documents")
    + """ SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(n_words AS INTEGER) AS n_words, kept
    FROM judged""",
)
def op10_line_dedup(spark, folder):
    return linedup.line_decisions(_table(spark, folder, "documents"))


@query("op11_toxicity")
def op11_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    model = toxicity.learn(docs, _table(spark, folder, "labels"))
    found = toxicity.score(docs, model)
    out = langid.held_out(found["doc_id"]).alias("held_out")
    predicted = F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", out, "score", predicted, "spans")


def _clusters_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Lloyd's rounds, one after the other; a centroid is a list of whole numbers."""
    parts = [
        f"""v AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id,
            list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE len(embedding) = {size}
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS j, e AS c FROM v
        ORDER BY j LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (
        SELECT row, vec_id, any_value(e) AS e, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
            SELECT row, vec_id, e, j,
                CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
            FROM v, c{i}) GROUP BY row, vec_id)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (
        SELECT j, pos, sum(x) AS s, count(*) AS n
        FROM (SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY j, pos),
    c{i + 1} AS MATERIALIZED (
        SELECT c{i}.j, coalesce(w.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
            SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM m{i} GROUP BY j) w
        ON w.j = c{i}.j)"""
            )
    last = rounds
    return (
        "WITH "
        + ",\n    ".join(parts)
        + f"""
    SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance,
        CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{last} a JOIN c{last} c ON c.j = a.j"""
    )


@query("op12_centroids", _clusters_sql())
def op12_centroids(spark, folder):
    return centroids.cluster(_table(spark, folder, "embeddings"))


def _repair_sql() -> str:
    """The repair from the last row on: the best (cost, edits, lines) for each of the four states."""
    insert = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    keep = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}

    def put(cost: str, edit: str, line: str, then: str) -> str:
        return f"{{'c': {cost} + {then}.c, 'e': '{edit}' || {then}.e, 't': {line} || {then}.t}}"

    def row(q: int) -> str:
        options = [put("2", "D", "''", f"v{q}")]
        for initial, to in keep[q]:
            kept = put("cut", "K", "chr(10) || role || ':' || text", f"v{to}")
            options.append(f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {kept} END")
        to, role = insert[q]
        changed = put("cut + 1", "R", f"chr(10) || '{role}:' || text", f"v{to}")
        options.append(f"CASE WHEN NOT gone THEN {changed} END")
        return f"list_min([{', '.join(options)}]) AS w{q}"

    def closed(q: int, old: str, new: str) -> str:
        to, role = insert[q]
        inserted = put("5", "I", f"chr(10) || '{role}:'", f"{old}{to}")
        return f"list_min([{old}{q}, {inserted}]) AS {new}{q}"

    rows = ", ".join(row(q) for q in range(4))
    once = ", ".join(closed(q, "w", "x") for q in range(4))
    twice = ", ".join(closed(q, "x", "v") for q in range(4))
    return rf"""WITH RECURSIVE crc_table AS (
        SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
        FROM range(256) r(i)),
    keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    kinds AS (
        SELECT k.*, xor(4294967295, list_reduce(list_prepend(4294967295,
                list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) % 20 AS kind FROM keyed k, crc_table),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    faults AS (
        SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
        FROM placed),
    best AS (
        SELECT DISTINCT conv_id, CAST(n + 1 AS BIGINT) AS i, {{'c': 0, 'e': '', 't': ''}} AS v0,
            {{'c': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS v1,
            {{'c': 5, 'e': 'I', 't': chr(10) || 'assistant:'}} AS v2, {{'c': 0, 'e': '', 't': ''}} AS v3 FROM faults
        UNION ALL
        SELECT conv_id, i, {twice} FROM (SELECT conv_id, i, {once} FROM (SELECT conv_id, i, {rows} FROM (
            SELECT f.conv_id, f.i, f.role, f.text, f.fault IN (1, 2) AS gone,
                CASE WHEN f.fault = 3 THEN 5 ELSE 0 END AS cut, v0, v1, v2, v3
            FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1)))),
    facts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
            count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY conv_id)
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
        coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(b.v0.c, 0) AS BIGINT) AS cost, coalesce(b.v0.e, '') AS audit,
        sha256(coalesce(substr(b.v0.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best b ON b.i = 1 AND b.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op13_conversations", _repair_sql())
def op13_conversations(spark, folder):
    rows = turns.prepare(_table(spark, folder, "conversations"))
    return turns.summaries(turns.damage(rows))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
