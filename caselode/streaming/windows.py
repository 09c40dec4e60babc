"""Windowed sums and resumed work for batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total); on a stream, events later than ``late`` are left out and state is bounded."""
    kind = events.schema["ts"].dataType
    # Watermarks need a time with a zone; the start is given back in the input's type.
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def remaining(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among those done."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def resumed(pending: DataFrame, done: DataFrame, key: list[str], handle, checkpoint: str):
    """Start a stream that hands each micro-batch's rows, less those already done, to ``handle(df, batch_id)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        handle(remaining(batch, done, key), batch_id)

    return pending.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
