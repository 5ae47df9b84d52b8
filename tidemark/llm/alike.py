"""Near copies by similarity: tries over several SimHash fingerprints find the pairs, the shingles decide.

Nodes are distinct sets of shingles, so copies, however many, are one node. A node has ``len(WORDS)`` fingerprints of 64 bits
over its set (each bit set if over half of the shingles' hashes set it). Two sets of Jaccard similarity 0.8 differ in 15 % of the bits on average,
so no single small budget finds most of them. Instead there are nine tries, three of each of three fingerprints, with other bits on top: a pair is a candidate
if in any of them at most two of the first 16, three of the first 20 and 17 of the 64 bits differ, and at most ``WHOLE`` of all. By the binomial law that
finds 98.9 % of the pairs at 0.8, 99.8 % at 0.82 and all but one in 10,000 at 0.85; a class that is connected by more than one link loses less.
Of pairs at 0.7 a third are compared, of those at 0.6 two in a thousand.

1. Crowds. In each of a few rounds one trie gives links that connect something new, nearest first; these are compared by their shingles. What is joined
   by links that passed is a group, and later rounds link groups: so a crowd of near copies costs a few links per member instead of all its pairs.
2. All tries give all candidates of different groups; these are compared by their shingles. Only links that passed count, so
   pages of one template, near each other without being similar enough, do not hide each other's copies.

What comes out depends on the texts alone, not on how they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import connected_components
from tidemark.llm.simhash import CHUNK, shingle_hashes
from tidemark.llm.tokens import slices
from tidemark.llm.trie import Trie, joined
from tidemark.llm.worker import release
from tidemark.runtime import materialize, ship

WORDS = tuple(f"__w{k}" for k in range(8))
WHOLE = 96  # of 512 bits; 77 differ on average at a similarity of 0.8, with a standard deviation of 8
LIMITS = ((16, 2), (20, 3), (64, 17))
TRIES = [Trie(word, turn, LIMITS) for word in range(3) for turn in (0, 21, 42)]
ROUNDS = (0, 4, 8)  # the tries of the rounds: one of each word
BROADCAST_NODES = 200_000  # ends of links up to which they are broadcast, 24 bytes each
EPS = 1e-9


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles; that of the empty set is 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64)) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of a set; 0 for none."""
    ones = np.zeros(64 * len(WORDS), dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        columns = [part]
        for k in range(1, len(WORDS)):
            x = (part ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            columns.append(x ^ (x >> np.uint64(32)))
        ones += np.unpackbits(np.stack(columns, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


def sketched(df: DataFrame, width: int, text: str, result: str) -> DataFrame:
    """``df`` without its text, with the name of its set and the set's fingerprints."""
    ship(df.sparkSession)
    others = [f for f in df.schema.fields if f.name not in (text, result, *WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(text).to_pylist()]
            words = np.asarray([sketch(s) for s in sets], dtype=np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            columns = [*(batch.column(f.name) for f in others), pa.array([set_name(s) for s in sets], pa.int64()), *(pa.array(words[:, k].copy()) for k in range(len(WORDS)))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in others), result, *WORDS])

    return df.mapInArrow(run, T.StructType([*others, *(T.StructField(c, T.LongType()) for c in (result, *WORDS))]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def compared(links: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, least: float, name: str) -> DataFrame:
    """The links whose sets are similar enough. Only texts at the end of a link are read into sets, one for each set."""
    links = materialize(links, f"{name}-candidates")
    ends = links.select(F.col("u").alias("fp")).unionByName(links.select(F.col("v").alias("fp"))).distinct()
    wanted = materialize(distinct.join(ends, "fp", "left_semi").select(F.col("row")[doc_id].alias("__id"), F.col("row")["body"].alias("__body")), f"{name}-ends")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs[doc_id].eqNullSafe(wanted["__id"]) & docs["body"].eqNullSafe(wanted["__body"]), "left_semi").select(F.col(text).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            made = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            # Half of each hash is plenty for the overlap of two texts.
            small = [np.unique(s.astype(np.uint32)).tobytes() for s in made]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in made], pa.int64()), pa.array(small, pa.binary())], ["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            halves = ([np.frombuffer(x.as_py(), dtype=np.uint32) for x in batch.column(k)] for k in (2, 3))
            near = [jaccard(x, y) >= least - EPS for x, y in zip(*halves, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    # Rows of one id and text may be repeated: their sets are the same, and distinct() would have to sort them.
    sets = materialize(texts.mapInArrow(make, "node long, shingles binary"), f"{name}-sets")
    left = links.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return materialize(both.mapInArrow(run, "u long, v long").distinct(), f"{name}-links")


def similar_links(distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, width: int, least: float) -> DataFrame:
    """(u, v) names of sets that share at least ``least``; the classes that they make are those of all candidates that do.

    ``distinct`` has each set's name (``fp``), its fingerprints and one of its rows (``row``: id and body) of ``docs``.
    """
    nodes = distinct.select(F.col("fp").alias("node"), *WORDS)

    def passed(candidates: DataFrame, name: str) -> DataFrame:
        return compared(candidates, distinct, docs, doc_id, text, width, least, name)

    grouped, links = nodes.withColumn("grp", F.col("node")), None
    for trie in ROUNDS:
        found = passed(joined(grouped, [TRIES[trie]], list(WORDS), thin=True, whole=WHOLE, group="grp"), f"round-{trie}")
        links = found if links is None else links.unionByName(found)
        groups = connected_components(links)
        grouped = materialize(nodes.join(groups, "node", "left").select("node", *WORDS, F.coalesce("component", "node").alias("grp")), "grouped-sketches")
    rest = joined(grouped, TRIES, list(WORDS), thin=False, whole=WHOLE, group="grp", min_depth=2)
    return links.unionByName(passed(rest, "rest"))
