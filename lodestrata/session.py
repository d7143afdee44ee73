"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling on; a cluster's own settings stay."""
    builder = SparkSession.builder.appName("lodestrata").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set what the queries want of any session, where it has Spark's default: Arrow batches of at most 8 MB, since texts are long.

    The registered queries call this once per application; the setting stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(key, None) or "").rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(8 << 20))
    return spark
