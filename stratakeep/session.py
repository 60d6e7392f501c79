"""A session with the settings that the plans count on; existing settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stratakeep", **settings: str) -> SparkSession:
    """Adaptive execution (coalescing, skew joins) and UTC; partitions are sized to fit executor memory."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
