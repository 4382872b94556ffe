"""Event-time windows: an extension, beside the operators proper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, *keys: str, time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Sums, counts and extremes by window and keys. On a stream, rows later than `late` behind the newest are dropped."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "n", "least", "most")
