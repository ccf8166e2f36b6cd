"""Structured Streaming form of the slot totals; the batch engine does not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_totals(events: DataFrame, slot: str = "2 hours", late: str = "6 hours") -> DataFrame:
    """(slot_start, event_type, flow, n) of a stream of events (ts, event_type, value); a slot closes ``late`` after its end."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", slot).alias("w"), "event_type").agg(F.sum("value").alias("flow"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("slot_start"), "event_type", "flow", "n")
