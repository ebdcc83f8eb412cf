"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quern", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
