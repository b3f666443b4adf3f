"""Event-time windows: the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of ts; late: a watermark, for streams."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of bursts of events less than the gap apart."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """A stream without repeats of the key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
