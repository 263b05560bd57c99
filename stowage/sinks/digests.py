"""Digest tables kept between runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.scratch import save
from stowage.operators.skew import attach


#: log2 of the registers of a sketch, and the relative error that its estimates stay within in 95 of 100 cases.
SKETCH_BITS = 14
RELATIVE_ERROR = 2 * 1.04 / 2 ** (SKETCH_BITS / 2)


def sketch_of(hashed: DataFrame) -> DataFrame:
    """One row (files, sketch): the digests of a table as a sketch of bounded size that merges with others."""
    known = hashed.filter("hash is not null")
    return known.agg(
        F.count("*").alias("files"), F.hll_sketch_agg("hash", F.lit(SKETCH_BITS)).alias("sketch")
    )


def save_digests(hashed: DataFrame, folder: str, algorithm: str, generated: str, sketch: bool = False) -> None:
    """Parquet with columns hash, path, algorithm, generated; with ``sketch``, one beside it (``<folder>_sketch``).

    The sketch tells how many different digests the tables of many runs hold without reading them.
    """
    if sketch:
        hashed = save(hashed.select("hash", "path"), "digests")
        sketch_of(hashed).write.parquet(f"{folder.rstrip('/')}_sketch")
    hashed.filter("hash is not null").select(
        "hash", "path", F.lit(algorithm).alias("algorithm"), F.lit(generated).alias("generated")
    ).write.parquet(folder)


def save_digests_json(
    hashed: DataFrame, folder: str, algorithm: str, generated: str, line_end: str = "\n"
) -> None:
    """Text parts that concatenate, in name order, to one JSON document.

    Every key and every path is a line of its own, so a digest with any number of
    paths is written by many tasks.  ``line_end`` may be a space: one line then.
    """
    spark = hashed.sparkSession
    rows = save(hashed.filter("hash is not null").select("hash", "path"), "digests")
    keys = rows.groupBy("hash").agg(F.count("*").alias("_n"), F.max("path").alias("last"))
    total, final = rows.agg(F.count("*"), F.max("hash")).first()
    # to_json escapes the path; what surrounds the value is cut off.
    quoted = F.to_json(F.struct(F.col("path").alias("p")))
    quoted = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    comma = F.when(F.col("path") == F.col("last"), "").otherwise(",")
    items = attach(rows, keys, ["hash"], "_n").select(
        F.lit(1).alias("part"), "hash", F.lit(1).alias("kind"), "path",
        F.concat(F.lit("      "), quoted, comma).alias("line"),
    )
    opens = keys.select(
        F.lit(1).alias("part"), "hash", F.lit(0).alias("kind"), F.lit("").alias("path"),
        F.concat(F.lit('    "'), "hash", F.lit('": [')).alias("line"),
    )
    closes = keys.select(
        F.lit(1).alias("part"), "hash", F.lit(2).alias("kind"), F.lit("").alias("path"),
        F.when(F.col("hash") == F.lit(final), "    ]").otherwise("    ],").alias("line"),
    )
    head = [
        "{", '  "metadata": {', f'    "algorithm": {json.dumps(algorithm)},', f'    "generated": {json.dumps(generated)},',
        f'    "total_files": {total}', "  },", '  "hashes": {',
    ]
    frame = [(0, "", i, "", text) for i, text in enumerate(head)]
    frame += [(2, "", i, "", text) for i, text in enumerate(["  }", "}"])]
    outer = spark.createDataFrame(frame, "part int, hash string, kind int, path string, line string")
    lines = outer.unionByName(items).unionByName(opens).unionByName(closes)
    lines.orderBy("part", "hash", "kind", "path").select("line").write.option("lineSep", line_end).text(folder)
