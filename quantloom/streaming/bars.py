"""Hourly bars from a stream of events. An extension of ours: batch files are all that bars need otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Closed bars (append mode) per event type and hour, events later than `late` aside. `ts` must be a timestamp."""
    price = F.col("value") + 100.0
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("symbol")).agg(
        F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return bars.select("symbol", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume")
