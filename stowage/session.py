"""Session settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "stowage", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings this package expects.

    File times are shown in UTC.  AQE is left on because the operators rely on it to size
    shuffles and to split what skew remains in joins.  Parquet is written with a codec that finds a
    name in the one before even if both are long (chains of indices).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
