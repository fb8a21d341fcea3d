"""Job events as a stream: status counts by window, with late events up to a watermark. Additive; batch queries do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(events: DataFrame, time: str = "ts", status: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, status, n) of a batch or streaming frame of events."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), status, "n")
