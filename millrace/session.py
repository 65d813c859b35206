"""Spark session with the settings the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamp_ntz round trips exact; ANSI makes overflow an error instead of a wrong number.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with SETTINGS; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
