"""Documents to packed sequences: language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the documents of the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import langid, linedup, minhash, packing
from stowage.llm.common import marked, pick, unpack_rows, whole_rows
from stowage.operators.scratch import save, save_step

#: Percent of shared words from which the later of two lines goes, as for shingles of documents.
LINE_PERCENT = 75


def _identity() -> list[Column]:
    """A document's id, null or not, and the hash of its text."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h")]


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` but those in ``decided`` (doc, h, once), of which one row is left if ``once`` says so.

    Only documents that are decided on, and few others, are shuffled.
    """
    bit_set = marked(decided.select(F.xxhash64("doc", "h").alias("hash")))
    rows = whole_rows(docs, "doc_id", "text").select(*_identity(), "_row")
    held = bit_set("xxhash64(doc, h)")
    found = rows.filter(held).withColumnRenamed("doc", "_doc").withColumnRenamed("h", "_h")
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_h") == F.col("h"))
    found = found.join(decided.distinct(), same, "left")
    one = found.filter("once").dropDuplicates(["_doc", "_h"]).select("_row")
    others = found.filter("once is null").select("_row")
    return unpack_rows(rows.filter(~held).select("_row").unionByName(others).unionByName(one), docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Rejected are texts without a letter (null and empty ones as well), and those that fit the profile of their
    language less than nearly all texts of like length it was learned from (``langid.least_scores``); profiles and
    scores are those of all learning texts.  ``lang`` stays as it is.
    """
    def rejected() -> DataFrame:
        found = langid.identify(pick(docs, "doc_id", "text", "lang"), langid.learn(docs))
        length = langid.length_class(F.col("text")).alias("length")
        found = found.select(*_identity(), length, langid.learnable().alias("known"), "lang_pred", "score")
        scored = save(found, "scored")
        least = langid.least_scores(scored.filter("known"), F.col("length"))
        floor = F.lit(least[None])
        for c, score in least.items():
            if c is not None:
                floor = F.when(F.col("length") == c, F.lit(score)).otherwise(floor)
        kept = (F.col("lang_pred") != "und") & (F.col("score") >= floor)
        return scored.filter(~kept).select("doc", "h", F.lit(False).alias("once"))

    return _without(docs, save_step(spark, rejected, "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are nearly equal to earlier ones, in order of ids, then line numbers.

    Lines go at the level of ``near_duplicates``: were edited lines to stay where equal ones go, what is
    left of a near copy would no longer be near anything.  Documents that lose all lines with words go; null and
    empty texts and rows without an id are treated as ``linedup.dedup_lines`` states.
    """
    return linedup.dedup_lines(docs, percent=LINE_PERCENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Documents without an id are in no group and stay.  A document is its id and its text: a repeated row stays
    once, and of two texts under one id each is kept or goes by its own group.
    """
    def decided() -> DataFrame:
        found = minhash.near_duplicates(docs).filter("doc_id is not null")
        found = save(found.select("doc_id", "text_hash", "kept", "group_id"), "found")
        best = F.min(F.struct("doc_id", "text_hash")).alias("best")
        of_groups = found.filter("kept and group_id is not null").groupBy("group_id").agg(best).select("best.*")
        alone = found.filter("kept and group_id is null").select("doc_id", "text_hash").distinct()
        stay = of_groups.unionByName(alone).withColumn("once", F.lit(True))
        times = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
        times = times.join(stay, ["doc_id", "text_hash"], "left").filter("once is null or n > 1")
        return times.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("h"), F.coalesce("once", F.lit(False)).alias("once"))

    return _without(docs, save_step(spark, decided, "decided"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: The model, the tokenizer and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents; no documents give no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_step(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
