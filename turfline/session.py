"""Session settings the plans are tuned with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins from the sizes seen at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast a side only if it is at most this large.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    # Per-play tables are thin beside the frames: hash their partitions instead
    # of sorting the frames, if every partition is small enough.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder; set master and sizes there as well."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
