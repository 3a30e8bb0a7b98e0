"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, **extra: str) -> SparkSession:
    """UTC, adaptive execution, and maps in which the last of equal keys wins. Values in `extra` use _ for . in names."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for key, value in (conf | {k.replace("_", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
