"""Review decisions as a stream: the latest event of each reference, kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_stream(events: DataFrame) -> DataFrame:
    """The batch fold as a streaming aggregate: one row per (doc_id, n), updated as events arrive."""
    return events.groupBy("doc_id", "n").agg(F.max_by(F.struct("at", "action"), F.struct("at", "action")).alias("e")).select("doc_id", "n", "e.at", "e.action")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and type; later ones than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("k"), F.sum("value").alias("total"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
