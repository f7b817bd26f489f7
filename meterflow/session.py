"""The session the library is meant to run in; every setting can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "meterflow", **settings: str) -> SparkSession:
    """A session with the library's settings; local ones only where a caller passes a master."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()
