"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC reports, adaptive joins and partitions, Arrow for the few Python parts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """The running session, or a new one; a cluster's own settings win unless given here."""
    builder = SparkSession.builder.appName("tidewell")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
