"""Structured streaming forms (beyond the batch semantics): idempotent intake of content, windowed counts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_content(stream: DataFrame, content: str, when: str, late: str = "1 day") -> DataFrame:
    """Each content once, within the lateness allowed: a second delivery of the same bytes changes nothing."""
    return stream.withColumn("content_key", F.sha2(F.col(content).cast("binary"), 256)).withWatermark(when, late).dropDuplicatesWithinWatermark(["content_key"])


def windowed(stream: DataFrame, when: str, key: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(when, late).groupBy(F.window(when, width), key)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, when: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(when, late).groupBy(F.session_window(when, gap), key)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
