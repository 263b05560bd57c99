"""Given tables seen as file collections: the same definition for Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.scratch import new_folder, save
from stowage.sources import digests
from stowage.sources.tables import from_table

#: Sources whose documents count as already in place; all others are incoming.
IN_PLACE = ["src0", "src4", "src8", "src12", "src16"]
#: Sources whose documents are moved away.
MOVED = ["src0", "src1", "src2"]
JUNK = [".DE", "fr"]
EPOCH = 1704067200  # 2024-01-01


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """documents as <source>/doc<id>.<lang>; some directories are hidden."""
    t = table(spark, folder, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    hidden = F.when(F.col("doc_id") % 17 == 0, ".").otherwise("")
    extra = {"source": F.col("source"), "lang": F.col("lang")}
    if content:
        extra["text"] = F.col("text")
    return from_table(
        t,
        F.concat(hidden, "source", F.lit("/"), name),
        size=F.octet_length("text"),
        mtime=F.timestamp_seconds(F.lit(EPOCH) + (F.col("doc_id") * 7919) % 100003),
        **extra,
    )


DOCS = """docs AS (
  SELECT *, dir || '/' || name AS path FROM (
    SELECT doc_id, text, lang, source,
      CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || source AS dir,
      'doc' || doc_id || '.' || lang AS name,
      CAST(octet_length(encode(text)) AS BIGINT) AS size,
      1704067200 + (doc_id * 7919) % 100003 AS mtime
    FROM documents))"""


def hashed_docs(spark: SparkSession, folder: str, algorithm: str = "sha256") -> DataFrame:
    """Narrow digest table of all documents, written once."""
    rows = docs(spark, folder, content=True)
    return save(
        rows.select(
            "path", "name", "dir", "rel_path", "size", "mtime", "source", "lang",
            digests.digest(F.col("text"), algorithm).alias("hash"),
        ),
        "digests",
    )


HASHED = DOCS + ",\nhashed AS (SELECT *, sha256(text) AS hash FROM docs)"


def flat_docs(spark: SparkSession, folder: str) -> DataFrame:
    """documents as direct children of one directory."""
    t = table(spark, folder, "documents")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return from_table(t, name, size=F.octet_length("text"), source=F.col("source"))


FLAT = """flat AS (
  SELECT 'doc' || doc_id || '.' || lang AS path, source, lang,
    CAST(octet_length(encode(text)) AS BIGINT) AS size
  FROM documents)"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages by url without its scheme; a name may be empty or carry a query."""
    t = table(spark, folder, "pages")
    rel = F.regexp_replace("url", r"^[a-z]+://", "")
    return from_table(t, rel, size=F.octet_length("html"), page_id=F.col("page_id"), html=F.col("html"))


PAGES = """pgs AS (
  SELECT page_id, html, rel AS path, regexp_extract(rel, '[^/]*$') AS name,
    CAST(octet_length(encode(html)) AS BIGINT) AS size
  FROM (SELECT page_id, html, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages))"""


def photos(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """orders as photos with EXIF tags: some dates are garbage, some photos have none."""
    t = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    manifest = from_table(
        t,
        F.concat(F.lit("card/IMG_"), key.cast("string"), F.when(key % 3 == 0, ".JPG").otherwise(".heic")),
        size=key,
    )
    path = F.concat(F.lit("card/IMG_"), key.cast("string"), F.when(key % 3 == 0, ".JPG").otherwise(".heic"))
    day = F.col("o_orderdate")
    first = F.when(key % 7 == 0, "garbage").otherwise(F.date_format(day, "yyyy:MM:dd HH:mm:ss"))
    second = F.date_format(F.date_add(day, 1), "yyyy-MM-dd HH:mm:ss")
    stored = F.when(key % 11 == 0, F.array()).when(
        key % 5 == 0,
        F.array(
            F.struct(F.lit("DateTime").alias("tag"), F.lit("never").alias("value")),
            F.struct(
                F.lit("Make").alias("tag"), F.concat(F.lit(" Cam/"), "o_orderpriority", F.lit(" ")).alias("value")
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(F.lit("DateTime").alias("tag"), first.alias("value")),
            F.struct(F.lit("DateTimeOriginal").alias("tag"), second.alias("value")),
            F.struct(F.lit("Make").alias("tag"), F.col("o_orderpriority").alias("value")),
        )
    )
    typed = stored.cast("array<struct<tag:string,value:string>>")
    tags = t.select(path.alias("path"), F.posexplode(typed).alias("pos", "t")).select(
        "path", "pos", F.col("t.tag").alias("tag"), F.col("t.value").alias("value")
    )
    return manifest, tags


# The date a photo ends up with: its first tag, or its second where that one is garbage.
PHOTOS = """photos AS (
  SELECT o_orderkey AS size, 'IMG_' || o_orderkey AS stem,
    CASE WHEN o_orderkey % 3 = 0 THEN '.JPG' ELSE '.heic' END AS suffix,
    CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN NULL
      WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP)
      ELSE o_orderdate END AS taken,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
      WHEN o_orderkey % 5 = 0 THEN 'Cam/' || o_orderpriority
      ELSE o_orderpriority END AS make
  FROM orders)"""


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """orders as videos with probe output: five date formats, three keys, some broken."""
    t = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    day = F.col("o_orderdate")
    text = (
        F.when(key % 13 == 0, "0000-00-00T00:00:00.000000Z")
        .when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key % 5 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(key % 5 == 3, F.date_format(day, "yyyy:MM:dd HH:mm:ss"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    field = F.when(key % 3 == 0, "creation_time").when(key % 3 == 1, "date").otherwise("DATE")
    good = F.concat(F.lit('{"format": {"tags": {"'), field, F.lit('": "'), text, F.lit('"}}}'))
    probe = F.when(key % 17 == 0, "not json").when(key % 19 == 0, "{}").otherwise(good)
    return from_table(
        t,
        F.concat(F.lit("cam/clip"), key.cast("string"), F.lit(".MP4")),
        size=key,
        mtime=F.timestamp_seconds(F.lit(EPOCH) + key),
        probe=probe,
    )


VIDEOS = """videos AS (
  SELECT *, coalesce(found, make_timestamp((1704067200 + size) * 1000000)) AS taken FROM (
    SELECT o_orderkey AS size, 'clip' || o_orderkey AS stem, '.MP4' AS suffix,
      o_orderkey % 17 = 0 AS failed,
      CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 13 = 0 THEN NULL
        ELSE o_orderdate END AS found
    FROM orders))"""


def music(spark: SparkSession, folder: str) -> DataFrame:
    """part as music: brand, type and name as tags; some artists are missing."""
    t = table(spark, folder, "part")
    key = F.col("p_partkey")
    pairs = F.array(
        F.when(key % 9 != 0, F.struct(F.lit("TPE1").alias("k"), F.array("p_brand").alias("v"))),
        F.struct(F.lit("TPE2").alias("k"), F.array(F.lit("Various: All")).alias("v")),
        F.struct(F.lit("ALBUM").alias("k"), F.array("p_type").alias("v")),
        F.when(key % 4 != 0, F.struct(F.lit("TIT2").alias("k"), F.array("p_name").alias("v"))),
        F.when(
            key % 6 != 0,
            F.struct(F.lit("TRCK").alias("k"), F.array(F.concat(F.col("p_size").cast("string"), F.lit("/50"))).alias("v")),
        ),
    )
    return from_table(
        t,
        F.concat(F.lit("disc/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), key.cast("string"), F.lit(".mp3")),
        size=key,
        tags=F.map_from_entries(F.array_compact(pairs)),
    )


MUSIC = """music AS (
  SELECT p_partkey AS size, replace(p_name, ' ', '-') || '_' || p_partkey AS stem, '.mp3' AS suffix,
    CASE WHEN p_partkey % 9 <> 0 THEN p_brand ELSE 'Various_ All' END AS artist, p_type AS album,
    CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title,
    CASE WHEN p_partkey % 6 <> 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') END AS track
  FROM part)"""


def songs(spark: SparkSession, folder: str) -> DataFrame:
    """part as claims for names: one directory per type, many equal names."""
    return table(spark, folder, "part").select(
        F.col("p_type").alias("directory"),
        F.concat("p_name", F.lit(".mp3")).alias("name"),
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("brand"),
    )


SONGS = """songs AS (
  SELECT p_type AS directory, p_name AS stem, p_partkey AS ord, p_brand AS brand FROM part)"""


def _file_writer(folder: str):
    def write(texts):
        import os

        for rel, text in texts:
            target = os.path.join(folder, rel)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as stream:
                stream.write(text.encode())

    return write


def export_files(rows: DataFrame, label: str) -> str:
    """Write ``text`` of every row to a file <folder>/<rel_path>; returns the folder."""
    folder = new_folder(rows.sparkSession, label).removeprefix("file:")
    folder = "/" + folder.lstrip("/")
    # rows go to Python in batches of bounded bytes, not in thousands of texts of any length
    rows.select("rel_path", "text").foreachPartition(_file_writer(folder))
    return folder
