"""Exact-size uniform shuffle into shards, by a hypergeometric communication matrix.

1. Each input partition permutes its own rows (a sort by a seeded hash) and numbers them.
2. The matrix ``C[partition, shard]`` of row counts is drawn row by row from the multivariate
   hypergeometric law, given the partition sizes and the exact shard sizes. This is the law that a
   uniform permutation of all rows would induce.
3. Rows ``C[p, 0] + .. + C[p, s-1] <= rank < C[p, 0] + .. + C[p, s]`` of partition ``p`` go to shard ``s``.
4. Each shard permutes what it received and numbers it without gaps.

Only the counts meet on the driver: one row per input partition. Rows are moved once, by shard and by
a slice of the random key, so that a shard of any size is ordered by many tasks.

Defined cases: a null text counts no bytes and has checksum 0; a null or repeated key is a row like any
other; an empty table gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import materialize

LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
BROADCAST_PARTITIONS = 50_000  # rows of the matrix up to which it is broadcast (24 longs each: 10 MB)


def _log_choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def draw_hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` without replacement are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    left = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts by partition and shard with exact margins; the shard sizes are at most one apart."""
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng, matrix = random.Random(seed), []
    for size in sizes:
        row, left, rest = [], size, sum(room)
        for s in range(shards):
            rest -= room[s]
            taken = draw_hypergeometric(rng, room[s], rest, left)
            row.append(taken)
            left -= taken
        room = [r - t for r, t in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_uniformly(df: DataFrame, key_columns: list[str], shards: int = 24, seed: int = 20240229, slice_rows: int = 100_000) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``key_columns`` seed the random order; rows equal in all of them are interchangeable.
    """
    spark = df.sparkSession
    base = df.drop("shard", "slot")
    keyed = base.withColumn("__key", F.xxhash64(F.lit(seed), *key_columns))
    numbered = keyed.sortWithinPartitions("__key", *key_columns).withColumn("__id", F.monotonically_increasing_id())
    numbered = materialize(
        numbered.withColumn("__part", F.shiftrightunsigned("__id", LOCAL_BITS)).withColumn("__rank", F.col("__id").bitwiseAND((1 << LOCAL_BITS) - 1)).drop("__id"),
        "shard-local",
    )
    # One row per input partition: the only thing the driver sees.
    sizes = sorted((r["__part"], r["n"]) for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    rows = []
    for (part, _), counts in zip(sizes, communication_matrix([n for _, n in sizes], shards, seed), strict=True):
        bounds, reached = [], 0
        for c in counts:
            reached += c
            bounds.append(reached)
        rows.append((part, bounds))
    matrix = spark.createDataFrame(rows, "__part long, __bounds array<long>")
    if len(rows) <= BROADCAST_PARTITIONS:
        matrix = F.broadcast(matrix)
    slices = max(1, -(-total // (shards * slice_rows)))
    sent = (
        numbered.join(matrix, "__part")
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__rank"))).cast("int"))
        .drop("__bounds")
        # The row's place in its partition too: rows that are equal in all keys are spread over the slices.
        .withColumn("__again", F.xxhash64(F.lit(seed + 1), "__key", "__part", "__rank"))
        .withColumn("__slice", F.pmod(F.shiftrightunsigned("__again", 32), F.lit(slices)).cast("int"))
        .drop("__part", "__rank")
    )
    counts = sent.groupBy("shard", "__slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard"), F.col("__slice"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__slice").orderBy("__again", *key_columns)
    ordered = sent.withColumn("__place", F.row_number().over(inside).cast("long") - 1)
    if shards * slices <= BROADCAST_PARTITIONS:
        starts = F.broadcast(starts)
    return ordered.join(starts, ["shard", "__slice"]).withColumn("slot", F.col("__start") + F.col("__place")).select(*base.columns, "shard", "slot")


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Contract rows: documents by the law ``rows``, with the size and checksum of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    return shard_uniformly(rows, ["doc_id", "size", "text_crc32"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
