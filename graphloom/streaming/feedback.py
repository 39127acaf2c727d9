"""Streaming upsert of feedback into a versioned decision table, and a windowed count of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.feedback import updated

SCHEMA = "feedback_id string, ts timestamp, decision_id string, feedback string"


def upsert_stream(stream: DataFrame, read_decisions, write_decisions, checkpoint: str, late: str = "1 hour", export=None):
    """Start a query that applies each micro-batch to the decisions and, where export(batch_id) is given, exports them anew.

    Retries are dropped by feedback_id within the watermark; read_decisions() and write_decisions(df, batch_id) must make a
    batch that is replayed overwrite its own version.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["feedback_id"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_decisions(updated(read_decisions(), batch), batch_id)
        if export is not None:
            export(batch_id)

    return once.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per window and kind; works on streams and on tables alike."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), kind, "n", "total")
