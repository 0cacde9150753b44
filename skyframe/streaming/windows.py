"""Extension: continuous queries. The batch operators have no unbounded source; these are their streaming companions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """start, end, keys, n per (sliding) window; rows later than ``late`` are dropped, and state is kept only that long."""
    w = F.window(time, width, slide or width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def once_each(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the watermark: redelivered rows count once, with bounded state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, write_batch, checkpoint: str, mode: str = "append"):
    """Run ``write_batch(df, number)`` on every micro-batch that is available, then stop (incremental ingest). With mode
    'complete' a batch is the whole result so far."""
    return stream.writeStream.outputMode(mode).foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
