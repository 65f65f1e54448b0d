"""Structured streams: commits as they arrive, and windowed event counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "generation long, id string, parent_sha string, time double"


def commit_stream(spark: SparkSession, root: str) -> DataFrame:
    """One row for each commit of a versioned database, each file read once and in any order."""
    return spark.readStream.schema(_COMMIT).json(f"{root.rstrip('/')}/commits")


def tumbling_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window and key; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions by key that end after a gap without events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
