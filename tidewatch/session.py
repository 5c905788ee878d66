"""The session the engine expects: UTC, adaptive execution, duplicate JSON keys as the last one."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change while a session runs."""
    for key, value in SETTINGS.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # static on some clusters; set it at start there
            continue
    return spark


def session(name: str = "tidewatch", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
