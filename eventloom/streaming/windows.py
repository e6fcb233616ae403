"""Streaming forms of the windowed counts, with watermarks for late rows; the batch forms are the same functions over a static frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """(start, end, event_type, n, total): counts and sums of tumbling windows, sliding ones if `slide` is given."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    got = marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than `gap` apart."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    got = marked.groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
