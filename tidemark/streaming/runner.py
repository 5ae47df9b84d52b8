"""Running the streaming forms: one clock per source partition, checkpointed state, exactly-once files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.queries import clocked
from tidemark.runtime import scratch_path
from tidemark.sources.events import partition_streams
from tidemark.sources.log import write_results

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # The slowest partition decides: a window is final once all of them have left it.
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that these settings do not leak into the caller's."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    for key, value in SETTINGS.items():
        session.conf.set(key, value)
    return session


def union_all(streams: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, streams)


def clocked_union(streams: list[DataFrame], narrow: Callable[[DataFrame], DataFrame], length_ms: int) -> DataFrame:
    """Narrow each partition to one event type before its watermark: other types do not advance the clock."""
    return union_all([clocked(narrow(s), length_ms) for s in streams])


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there, emit what has closed, stop. A later call with the same checkpoint goes on."""
    write_results(result, path, checkpoint).awaitTermination()


def run_bounded(spark: SparkSession, sf_dir: str, build: Callable[[list[DataFrame]], DataFrame], name: str) -> DataFrame:
    """The streaming query ``build`` over the events of ``sf_dir``, run to its end; its output as a table."""
    session = stream_session(spark)
    result = build(partition_streams(session, sf_dir))
    path = scratch_path(spark, name)
    run_to_end(result, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{path}/out")
