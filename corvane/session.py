"""Session defaults: UTC, adaptive plans, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corvane", **conf: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster the given or submitted settings win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
