"""A SparkSession with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE splits skewed joins and merges small partitions; times are UTC; pandas goes through Arrow.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, settings: dict[str, str] | None = None, name: str = "cohortia") -> SparkSession:
    """Get or make a session; `settings` go over DEFAULTS, and a cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | (settings or {}))
    return (builder.master(master) if master else builder).getOrCreate()
