"""Structured Streaming forms: metrics of assignments as they arrive, and the newest decision on each line.

The batch operators hold the semantics; these keep them up to date over a stream of evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linekeeper.operators.metrics import has_timing, is_trusted


def live_metrics(assignments: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Assigned, trusted and low lines of each song and time window of ``ts``; rows later than ``late`` are dropped.

    A line that is sent again within the watermark counts once.
    """
    once = assignments.withWatermark("ts", late).dropDuplicatesWithinWatermark(["song", "entry"])
    counts = once.groupBy(F.window("ts", window), "song").agg(
        F.count(F.lit(1)).alias("timing_entries"), F.count_if(has_timing()).alias("assigned_entries"), F.count_if(is_trusted()).alias("trusted_entries")
    )
    return counts.select("song", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "timing_entries", "assigned_entries", "trusted_entries")


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan over each micro-batch and write its result under the batch's number, so that a repeated batch replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        plan(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
