"""Spark session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE re-plans skewed joins and rebalances; the two variant/session-window settings keep
# last-wins duplicate JSON keys and map-side merging of streaming sessions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


#: What results depend on: jobs set it where a session was made without `build_session`.
REQUIRED = {"spark.sql.variant.allowDuplicateKeys": "true"}


def require_settings(spark: SparkSession) -> None:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def build_session(app: str = "sightline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` uses `__` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
