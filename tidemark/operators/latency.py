"""Input completion, output time and latency of each window, from broker append times; throughput; samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import scaled_window_id, window_id


def finished(report: DataFrame) -> DataFrame:
    """Windows that the newest one has passed by two: the rest may still grow."""
    return report.filter(F.col("w") < report.agg(F.max("w") - 1).scalar())


def in_order(report: DataFrame) -> DataFrame:
    """A report as it is read: by window. One row per window, so the sort is small."""
    return report.orderBy("w")


def input_completion(records: DataFrame, length_ms: int, per_partition: bool = False, type_column: str = "event_type", scale: int = 1) -> DataFrame:
    """Latest append time of the bids of each window. The type is tested by substring."""
    w = scaled_window_id(F.col("t"), length_ms, scale) if scale > 1 else window_id(F.col("t"), length_ms)
    keys = ["partition", "w"] if per_partition else ["w"]
    return finished(records.filter(F.col(type_column).contains("Bid")).withColumn("w", w).groupBy(*keys).agg(F.max("append_ts").alias("input_ts")))


def output_time(outputs: DataFrame) -> DataFrame:
    """Earliest append time of the outputs of each window."""
    return finished(outputs.groupBy("w").agg(F.min("append_ts").alias("output_ts")))


def window_latency(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    return inputs.join(outputs, "w").select("w", (F.col("output_ts") - F.col("input_ts")).alias("latency_ms"))


def per_second(events: DataFrame, time: str = "append_ts") -> DataFrame:
    return events.groupBy("partition", F.call_function("div", F.col(time), F.lit(1000).cast("long")).alias("second")).agg(F.count("*").alias("n"))


def pass_through_sample(events: DataFrame, one_in: int = 400, deterministic: Column | None = None, seed: int = 1) -> DataFrame:
    """About one record in ``one_in``; with a whole-number column, those that leave a remainder of 1."""
    picked = events.filter(deterministic % one_in == 1) if deterministic is not None else events.sample(1.0 / one_in, seed)
    return picked.select("partition", F.lit(0).cast("long").alias("w"), "offset", "append_ts")


def sample_ids(samples: DataFrame) -> DataFrame:
    """Each sampled record gets a random identifier to follow it by, and the time at which it was seen."""
    return samples.withColumns({"uuid": F.uuid(), "seen_at": F.unix_millis(F.current_timestamp())})


def out_of_order(events: DataFrame) -> DataFrame:
    """(partition, n): events older than one that came before them in their partition."""
    before = Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    late = events.withColumn("newest", F.max("t").over(before)).filter(F.col("t") < F.col("newest"))
    return late.groupBy("partition").agg(F.count("*").alias("n"))


def skipped_windows(events: DataFrame, length_ms: int) -> DataFrame:
    """(partition, offset, from_w, to_w): where a partition's clock jumped by more than one window."""
    before = Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    clock = events.withColumn("newest", F.max("t").over(before)).filter(F.col("newest").isNotNull())
    jumps = clock.select("partition", "offset", window_id(F.col("newest"), length_ms).alias("from_w"), window_id(F.col("t"), length_ms).alias("to_w"))
    return jumps.filter(F.col("to_w") - F.col("from_w") > 1)
