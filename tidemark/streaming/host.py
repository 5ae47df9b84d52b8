"""A host for windowed aggregates over one stream with many source partitions, with an explicit clock per partition.

Every micro-batch is folded into partial states by (source partition, window, key) where it is read, those are merged with the open
windows that the batches before have left, and the windows that all partitions have passed are handed to ``combine`` and written out.
The state is a set of tables, one version per batch: partials of the open windows, the clocks, and the last window that was emitted. So the state is as
distributed as any DataFrame, no task holds all windows, and the source is read once for each aggregate, whatever the number of its partitions.

Exactly once: a batch writes its version and its results under its own number, and overwrites what an attempt before it has left. The version
that counts is that of the batch before, which the stream's checkpoint has committed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.windows import window_id
from tidemark.operators.aggregates import MergeableAggregate
from tidemark.runtime import delete_path

CLOCKS = "name string, partition long, clock long"
NOTICES = "name string, partition long, batch long, out_of_order long, from_w long, to_w long"


@dataclass(frozen=True)
class Hosted:
    """One aggregate of a query: ``narrow`` picks its events (partition, offset, t, ..) and so whose clocks count."""

    narrow: Callable[[DataFrame], DataFrame]
    aggregate: MergeableAggregate


class WindowedHost:
    """``combine`` turns the merged states of closed windows, by name, into results; it may join several."""

    def __init__(self, path: str, hosted: dict[str, Hosted], combine: Callable[[dict[str, DataFrame]], DataFrame], length_ms: int, n_partitions: int):
        self.path, self.hosted, self.combine = path.rstrip("/"), hosted, combine
        self.length_ms, self.n_partitions = length_ms, n_partitions

    # -- versions of the state

    def _at(self, batch: int, name: str) -> str:
        return f"{self.path}/state/{batch}/{name}"

    def _versions(self, spark: SparkSession) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def snapshot(self, spark: SparkSession, batch: int | None = None) -> dict[str, DataFrame]:
        """The state after a batch (the newest by default): ``clocks``, ``emitted`` and the open windows of each aggregate."""
        versions = self._versions(spark)
        if not versions:
            return {}
        at = versions[-1] if batch is None else batch
        return {name: spark.read.parquet(self._at(at, name)) for name in ("clocks", "emitted", *self.hosted)}

    # -- one micro-batch

    def process(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in self._versions(spark) if v < number]
        old = self.snapshot(spark, before[-1]) if before else {}
        emitted = old["emitted"].first()[0] if old else 0
        clocks_before = old["clocks"] if old else spark.createDataFrame([], CLOCKS)

        partials, clocks = {}, clocks_before
        for name, hosted in self.hosted.items():
            events = hosted.narrow(batch)
            # Partials and the newest time of a partition come from one pass over the batch.
            folded = hosted.aggregate.partials(events, self.length_ms, extra={"clock": F.max("t"), "oldest": F.min("t")})
            partials[name] = self._write(folded.filter("w IS NOT NULL"), self._at(number, f"batch-{name}"))
            clocks = clocks.unionByName(partials[name].groupBy("partition").agg(F.max("clock").alias("clock")).select(F.lit(name).alias("name"), "partition", "clock"))
        clocks = self._write(clocks.groupBy("name", "partition").agg(F.max("clock").alias("clock")), self._at(number, "clocks"))
        self._notice(partials, clocks_before, number)

        last = self._last_closed(clocks)
        states = {}
        for name, hosted in self.hosted.items():
            # A late row of a window that is out changes nothing.
            rows = partials[name].drop("clock", "oldest", "partition").filter(F.col("w") > emitted)
            if old:
                rows = rows.unionByName(old[name])
            states[name] = hosted.aggregate.merge(rows)
        if last is not None and last > emitted:
            done = {name: s.filter((F.col("w") >= 1) & (F.col("w") <= last)) for name, s in states.items()}
            self.combine(done).write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        for name, s in states.items():
            self._write(s if last is None else s.filter(F.col("w") > last), self._at(number, name))
        self._write(spark.createDataFrame([(max(emitted, last or 0),)], "w long"), self._at(number, "emitted"))
        for name in self.hosted:
            delete_path(spark, self._at(number, f"batch-{name}"))
        for v in before[:-1]:  # the version before stays, in case this batch is run again
            delete_path(spark, f"{self.path}/state/{v}")

    def _last_closed(self, clocks: DataFrame) -> int | None:
        """The highest window that every partition of every aggregate has left behind by two."""
        found = clocks.agg(F.count("*").alias("n"), (window_id(F.min("clock"), self.length_ms) - 2).alias("w")).first()
        return found["w"] if found["n"] == self.n_partitions * len(self.hosted) else None

    def _notice(self, partials: dict[str, DataFrame], clocks_before: DataFrame, number: int) -> None:
        """Where a partition's batch began before its clock, or its clock jumped by more than one window."""
        for name, folded in partials.items():
            now = folded.groupBy("partition").agg(F.max("clock").alias("now"), F.min("oldest").alias("oldest"))
            then = clocks_before.filter(F.col("name") == name).select("partition", "clock")
            moved = now.join(then, "partition").select(
                F.lit(name).alias("name"),
                "partition",
                F.lit(number).cast("long").alias("batch"),
                (F.col("oldest") < F.col("clock")).cast("long").alias("out_of_order"),
                window_id(F.col("clock"), self.length_ms).alias("from_w"),
                window_id(F.greatest("now", "clock"), self.length_ms).alias("to_w"),
            )
            self._write(moved.filter((F.col("out_of_order") > 0) | (F.col("to_w") - F.col("from_w") > 1)).coalesce(1), f"{self.path}/notices/{name}/batch={number}")

    @staticmethod
    def _write(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    # -- the stream

    def start(self, events: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def results(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/out")

    def notices(self, spark: SparkSession) -> DataFrame:
        """Out-of-order and skipped-window notices, by aggregate, partition and batch."""
        return spark.read.schema(NOTICES).option("recursiveFileLookup", "true").parquet(f"{self.path}/notices")
