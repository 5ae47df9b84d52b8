"""A window count with an explicit clock per source partition, for inputs with many partitions.

One watermark per partition needs one stream per partition. Here a single stream is pre-aggregated per
(partition, window) in every micro-batch, and one stateful operator keeps the clocks and the open windows.
Its state is checkpointed, clocks included, so a restart neither delays nor repeats a window.

The state's size is the number of partitions plus the open windows, whatever the number of events; the
operator sees one row per (partition, window) of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.windows import window_id
from tidemark.runtime import scratch_path, ship
from tidemark.sources.events import N_PARTITIONS, bids, stream_events

RESULT = "w long, n long"


class WindowedCount(StatefulProcessor):
    def __init__(self, n_partitions: int, length_ms: int):
        self.n_partitions, self.length_ms = n_partitions, length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clocks = handle.getMapState("clocks", "partition long", "t long")
        self.open = handle.getMapState("open", "w long", "n long")
        self.emitted = handle.getValueState("emitted", "w long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = self.emitted.get()[0] if self.emitted.exists() else 0
        for batch in rows:
            for p, t in batch.groupby("partition")["clock"].max().items():
                old = self.clocks.getValue((int(p),))
                self.clocks.updateValue((int(p),), (max(int(t), old[0] if old else -1),))
            for w, n in batch.groupby("w")["n"].sum().items():
                if w > done:  # a late row of an emitted window changes nothing
                    old = self.open.getValue((int(w),))
                    self.open.updateValue((int(w),), (int(n) + (old[0] if old else 0),))
        clocks = [t[0] for _, t in self.clocks.iterator()]
        if len(clocks) < self.n_partitions:
            return
        last = -(-min(clocks) // self.length_ms) - 2
        ready = sorted((w[0], n[0]) for w, n in self.open.iterator() if w[0] <= last)
        for w, _ in ready:
            self.open.removeKey((w,))
        if last > done:
            self.emitted.update((last,))
        if out := [r for r in ready if r[0] >= 1]:
            yield pd.DataFrame(out, columns=["w", "n"])

    def close(self) -> None:
        pass


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: one row per (partition, window) of each Arrow batch goes on to the shuffle."""
    for batch in batches:
        found = batch.groupby(["partition", "w"], as_index=False).agg(clock=("t", "max"), n=("t", "size"))
        yield found.assign(one=0)[["one", "partition", "w", "clock", "n"]]


def count_with_clock(bid_stream: DataFrame, length_ms: int, n_partitions: int) -> DataFrame:
    """Final counts per window of a stream of (partition, t)."""
    rows = bid_stream.select("partition", "t", window_id(F.col("t"), length_ms).alias("w")).filter(F.col("w").isNotNull())
    partial = rows.mapInPandas(combine, "one int, partition long, w long, clock long, n long")
    return partial.groupBy("one").transformWithStateInPandas(WindowedCount(n_partitions, length_ms), RESULT, "append", "none")


def bid_count_with_clock(length_ms: int, n_partitions: int = N_PARTITIONS) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidemark.streaming.runner import run_to_end, stream_session

        ship(spark)
        session = stream_session(spark)
        result = count_with_clock(bids(stream_events(session, sf_dir, n_partitions)), length_ms, n_partitions)
        path = scratch_path(spark, "clock")
        run_to_end(result, f"{path}/out", f"{path}/checkpoint")
        return spark.read.schema(RESULT).parquet(f"{path}/out")

    return run
