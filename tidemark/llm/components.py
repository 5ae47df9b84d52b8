"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step takes the smallest neighbour of each node (an aggregation with partial minima) and joins it
back to the edges, so no neighbourhood is ever collected: a node of very high degree is a skewed key of a
plain join, which adaptive execution splits. Each round is cut by a written table, and rounds are about
logarithmic in the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import delete_path, scratch_path


EDGES_PER_FILE = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _apart(least: DataFrame) -> DataFrame:
    """The minima as a table of their own: without the node's partitioning they are shuffled once more, few rows, and the join has two
    plain shuffles, of which adaptive execution splits a node that very many edges share."""
    return least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbourhood."""
    around = _both_ways(edges)
    least = _apart(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return around.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them. Edges point from large to small."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(_apart(least), "u")
    linked = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. ``edges``: (u, v) longs."""
    spark = edges.sparkSession
    current = edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    old, seen = None, None
    for _ in range(max_rounds):
        path = scratch_path(spark, "components")
        # As many files as the edges of the round before fill (later rounds have no more than the first).
        (current.coalesce(1 + seen[0] // EDGES_PER_FILE) if seen else current).write.parquet(path)
        current = spark.read.schema("u long, v long").parquet(path)
        if old:
            delete_path(spark, old)
        old = path
        # A star forest does not change any more: compare size and checksum with the round before.
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        current = _small_star(_large_star(current))
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
