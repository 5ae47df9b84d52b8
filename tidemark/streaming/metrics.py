"""Notices about a stream, as observed metrics of each micro-batch: they reach the query's progress reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.windows import window_id

NAME = "tidemark"


def observed(events: DataFrame, length_ms: int) -> DataFrame:
    """Rows, the oldest and newest event time, and how many windows the batch spans (over 2: one was skipped or is late)."""
    w = window_id(F.col("t"), length_ms)
    return events.observe(NAME, F.count("*").alias("rows"), F.min("t").alias("oldest"), F.max("t").alias("newest"), (F.max(w) - F.min(w) + 1).alias("windows"))


def throughput(query: StreamingQuery) -> list[tuple[str, float]]:
    """(batch start, input rows per second) of the recent micro-batches."""
    return [(p.timestamp, p.inputRowsPerSecond) for p in query.recentProgress]
