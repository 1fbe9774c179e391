"""Session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "tessera", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword (dots as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
