"""Which windows are final: the vector clock and the closing rule, over bounded data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import window_id


def vector_clock(events: DataFrame, by: tuple[str, ...] = ("partition",)) -> DataFrame:
    """The newest event time of each partition. Filter by event type first: only those advance the clock."""
    return events.groupBy(*by).agg(F.max("t").alias("clock"))


def clock_array(clocks: DataFrame, n_partitions: int) -> DataFrame:
    """One row: the clocks as an array by partition, 0 where a partition has none."""
    entry = lambda p: F.coalesce(F.max(F.when(F.col("partition") == p, F.col("clock"))), F.lit(0))
    return clocks.agg(F.array(*(entry(p) for p in range(n_partitions))).alias("clock"))


def merge_clock_arrays(a: Column, b: Column) -> Column:
    """The later time of each partition."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def last_closed(clocks: list[DataFrame], length_ms: int, n_partitions: int) -> DataFrame:
    """One row: the highest window that every partition of every aggregate has left behind by two.

    A partition without a matching event holds everything back (null, so nothing passes).
    """
    every = clocks[0].select("clock")
    for c in clocks[1:]:
        every = every.unionByName(c.select("clock"))
    enough = F.count("clock") == n_partitions * len(clocks)
    return every.agg(F.when(enough, window_id(F.min("clock"), length_ms) - 2).alias("last_w"))


def closed_only(results: DataFrame, last: DataFrame) -> DataFrame:
    """Windows 1 to the last closed one; window 0 is never emitted. ``last`` is a single row."""
    return results.filter((F.col("w") >= 1) & (F.col("w") <= last.scalar()))
