"""Continuous variants: time buckets with a watermark, and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per bucket of ``width`` and keys; rows later than ``late`` are left out.

    Works on a stream and, with the same result, on a bounded frame.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("bucket"), *keys, *[a for a in rows.sparkSession.createDataFrame([], rows.schema).groupBy(*keys).agg(*aggs).columns if a not in keys])


def refresh_each_batch(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``refresh(batch, epoch)`` for each micro-batch, once each after a restart."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).start()
