"""Streams: continuous ingest, rolling trace metrics, sessions. Each works on a batch too, which is its test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rolling_metrics(events: DataFrame, watermark: str | None = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count and mean by window and type; ``ts`` is a timestamp. Late rows beyond the watermark are left out of a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    grouped = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return grouped.select(F.col("window.start").alias("hour"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, watermark: str | None = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """A user's events fall into one session until ``gap`` passes without one."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    grouped = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def ingest(documents: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "source", stamp: str | None = None, watermark: str = "1 day") -> StreamingQuery:
    """Feed new documents to ``sink`` batch by batch, each key once.

    With ``stamp``, a timestamp column, keys are remembered for ``watermark`` only, so the state is bounded; the sink's own anti join
    (``IndexStore.build``) covers older ones.
    """
    fresh = documents.dropDuplicates([key]) if stamp is None else documents.withWatermark(stamp, watermark).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
