"""Decision rules of the control plane as queries: ownership, lag, heartbeats, snapshots.

Spark's scheduler does the work itself; these answer what the rules would decide for given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_ownership(*maps: DataFrame) -> DataFrame:
    """(partition, node_id, version): the higher version wins, equal ones go to the lower node."""
    rows = maps[0]
    for m in maps[1:]:
        rows = rows.unionByName(m)
    best = F.max_by(F.struct("node_id", "version"), F.struct(F.col("version"), (-F.col("node_id")).alias("n")))
    return rows.groupBy("partition").agg(best.alias("e")).select("partition", "e.node_id", "e.version")


def owner_of(partitions: DataFrame, ownership: DataFrame) -> DataFrame:
    return partitions.join(ownership, "partition", "left").select("partition", F.coalesce("node_id", F.lit(-1)).alias("node_id"))


def _side_by_side(current: DataFrame, new: DataFrame, how: str) -> DataFrame:
    old = current.select("partition", F.col("node_id").alias("old_node"), F.col("version").alias("old_version"))
    return new.join(old, "partition", how)


def newly_owned(current: DataFrame, new: DataFrame, me: int) -> DataFrame:
    """Mine in the new map, and unknown before or another node's at a lower version."""
    taken = (F.col("old_node") != me) & (F.col("version") > F.col("old_version"))
    return _side_by_side(current, new, "left").filter((F.col("node_id") == me) & (F.col("old_node").isNull() | taken)).select("partition")


def to_release(current: DataFrame, new: DataFrame, me: int) -> DataFrame:
    """Mine now, another node's in the new map at a higher version."""
    return _side_by_side(current, new, "inner").filter((F.col("old_node") == me) & (F.col("node_id") != me) & (F.col("version") > F.col("old_version"))).select("partition")


def initial_ownership(partitions: DataFrame, per_node: int) -> DataFrame:
    """Consecutive partitions go to the same node, ``per_node`` each, at version 0."""
    node = F.call_function("div", F.col("partition").cast("long"), F.lit(per_node).cast("long")).cast("int")
    return partitions.select("partition", node.alias("node_id"), F.lit(0).cast("long").alias("version"))


def set_owner(ownership: DataFrame, partitions: DataFrame, node_id: int, version: int) -> DataFrame:
    """The partitions' entries replaced by ``node_id`` at ``version`` (the control log's offset), whatever they were."""
    others = ownership.join(partitions.select("partition"), "partition", "left_anti")
    mine = partitions.select("partition", F.lit(node_id).cast(ownership.schema["node_id"].dataType).alias("node_id"), F.lit(version).cast(ownership.schema["version"].dataType).alias("version"))
    return others.unionByName(mine)


def dropped(current: DataFrame, new: DataFrame, me: int) -> DataFrame:
    """What a node lets go of when a new map arrives: all that it has to release but, if nothing would be left to it, the
    highest of those."""
    release = to_release(current, new, me)
    held = current.filter(F.col("node_id") == me).select("partition").unionByName(newly_owned(current, new, me)).distinct()
    all_of_them = release.agg(F.count("*")).scalar() == held.agg(F.count("*")).scalar()
    return release.filter(~(all_of_them & (F.col("partition") == release.agg(F.max("partition")).scalar())))


def settled(current: DataFrame, new: DataFrame, me: int, version: int) -> DataFrame:
    """The map after a new one has arrived: merged, and a partition that was kept is the node's own again, at ``version``."""
    kept = to_release(current, new, me).join(dropped(current, new, me), "partition", "left_anti")
    return set_owner(merge_ownership(current, new), kept, me, version)


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    return beats.groupBy("node_id").agg(F.max("ts").alias("ts"))


def last_seen(beats: DataFrame, nodes: DataFrame, started: int, threshold_ms: int) -> DataFrame:
    """(node_id, ts) of every node: its latest beat since ``started``, or ``started`` plus the threshold if there is none. Beats
    of nodes that are not in the list count too."""
    seeds = nodes.select("node_id", F.lit(started + threshold_ms).cast("long").alias("seed"))
    since = latest_heartbeats(beats.filter(F.col("ts") >= started))
    return seeds.join(since, "node_id", "full").select("node_id", F.coalesce("ts", "seed").alias("ts"))


def failed_nodes(beats: DataFrame, nodes: DataFrame, now: int, threshold_ms: int, started: int | None, last_check: int | None = None) -> DataFrame:
    """Nodes that have been silent for more than the threshold. None before checking has ``started``, nor within a
    threshold of the ``last_check``."""
    if started is None or (last_check is not None and now - last_check <= threshold_ms):
        return nodes.select("node_id").limit(0)
    return last_seen(beats, nodes, started, threshold_ms).filter(F.lit(now) - F.col("ts") > threshold_ms).select("node_id")


def newly_failed(failed: DataFrame, known: DataFrame) -> DataFrame:
    return failed.join(known, "node_id", "left_anti")


def ring_successor(failed: DataFrame, n_nodes: int) -> DataFrame:
    """For each failed node the next living one on the ring. All failed: no row."""
    steps = failed.select("node_id", F.explode(F.sequence(F.lit(1), F.lit(n_nodes - 1))).alias("d")).withColumn("candidate", (F.col("node_id") + F.col("d")) % n_nodes)
    alive = steps.join(failed.select(F.col("node_id").alias("candidate")), "candidate", "left_anti")
    return alive.groupBy("node_id").agg(F.min_by("candidate", "d").cast("int").alias("successor"))


def total_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("lag"))


def node_with_most_lag(lags: DataFrame) -> DataFrame:
    return lags.agg(F.max_by("node_id", F.struct(F.col("lag"), (-F.col("node_id")).alias("n"))).alias("node_id")).filter(F.col("node_id").isNotNull())


def partition_with_most_lag(lags: DataFrame) -> DataFrame:
    """Internal partitions (below 0) do not count; ties go to the first."""
    best = F.max_by(F.struct("partition", "lag"), F.struct(F.col("lag"), (-F.col("partition")).alias("p"))).alias("e")
    return lags.filter(F.col("partition") >= 0).agg(best).filter(F.col("e").isNotNull()).select("e.partition", "e.lag")


def hand_over(requested: DataFrame, lags: DataFrame) -> DataFrame:
    """Partitions to give away. Asked for none in particular: the one with most lag, if it lags at all. Nothing if as many are
    asked for as are owned, so that one always stays; of the others those that are owned. ``lags`` holds the owned partitions."""
    asked = requested.agg(F.count("*")).scalar()
    owned = lags.filter(F.col("partition") >= 0).select("partition")
    number = owned.agg(F.count("*")).scalar()
    stolen = partition_with_most_lag(lags).filter((F.col("lag") > 0) & (asked == 0) & (number != 1)).select("partition")
    return requested.select("partition").filter(asked != number).join(owned, "partition", "left_semi").unionByName(stolen)


def others_messages(messages: DataFrame, me: int) -> DataFrame:
    return messages.filter(F.col("sender_id") != me)


def merge_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot of the highest offset per partition; of equal ones the one that was there first."""
    best = F.max_by(F.struct("offset", "snapshot"), F.struct(F.col("offset"), (-F.col("arrival")).alias("a"))).alias("e")
    return snapshots.groupBy("partition").agg(best).select("partition", "e.offset", "e.snapshot")


def encode_snapshot(snapshots: DataFrame) -> DataFrame:
    """``offset:base64`` text, as snapshot files hold it."""
    return snapshots.select("partition", F.concat_ws(":", F.col("offset").cast("string"), F.base64(F.encode("snapshot", "UTF-8"))).alias("line"))


def decode_snapshot(lines: DataFrame) -> DataFrame:
    parts = F.split("line", ":")
    return lines.select("partition", parts[0].cast("long").alias("offset"), F.decode(F.unbase64(parts[1]), "UTF-8").alias("snapshot"))


def store_snapshots(snapshots: DataFrame, path: str) -> None:
    """The newest snapshot of each partition as a text file of its own folder, in any store that Spark can write."""
    encode_snapshot(merge_snapshots(snapshots)).select("partition", F.col("line").alias("value")).write.mode("overwrite").partitionBy("partition").text(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_snapshots`` has left: (partition, offset, snapshot)."""
    return decode_snapshot(spark.read.schema("value string, partition int").text(path).select("partition", F.col("value").alias("line")))
