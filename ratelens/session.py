"""A Spark session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ratelens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times and adaptive execution; other settings are given as key=value with _ for dots or by the cluster."""
    build = SparkSession.builder.appName(name)
    if master:
        build = build.master(master)
    build = build.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        build = build.config(key.replace("_", "."), value)
    return build.getOrCreate()
