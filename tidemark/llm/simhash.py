"""SimHash near-dedup: fingerprints joined with themselves by walking a binary trie in node pairs.

Fingerprint: the words of a text (ASCII white space apart, A-Z lower-cased) in shingles; the XXH64 (seed 42) of each
shingle votes on 64 bits, and a bit is set if over half of the shingles set it. Equal fingerprints
are one node, so copies, however many, are joined once.

Self-join (``trie.py``): the fingerprints are the leaves of a binary trie, which is walked against itself in pairs of nodes. The
differing bits are added up from the top, and a pair is pruned when they exceed the budget. Of two fingerprints within
``budget`` bits, either the upper halves differ in at most half of it, or the lower halves in less than that: so there are two tries, one
with the upper and one with the lower half on top, whose upper 32 levels have just that budget. Links are
emitted where they connect something new (in each task at most members - 1): the classes that all
links make, without all the pairs of a crowd.

Near copies by similarity (``near_duplicates`` with ``min_jaccard``) are candidates of the same tries over several
fingerprints, verified on the shingles: see ``alike.py``.

Defined cases: a null or empty text has no words and the fingerprint 0, linked like any other; fewer words
than a shingle make one shingle; repeated rows share a class; ids may repeat (the class is by
fingerprint); null ids are in a class but never name one; an empty table gives an empty one; other columns pass.
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
from tidemark.llm.trie import Trie, joined
from tidemark.runtime import materialize, ship

BITS, SEED = 64, 42
BUDGET = 4
MIN_DEPTH = 6  # the top levels that are walked before the tasks get their pairs of nodes
CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and exactly [\x20\x09-\x0D].
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.asarray([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes set it; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(df: DataFrame, width: int, text: str = "text", result: str = "fp") -> DataFrame:
    """``df`` without its text, with the fingerprint as a signed long."""
    ship(df.sparkSession)
    kept = df.drop(result)
    others = [f for f in kept.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray([simhash(shingle_hashes(t, width)) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(found)], [*(f.name for f in others), result])

    return kept.mapInArrow(run, T.StructType([*others, T.StructField(result, T.LongType())]))


def tries_of(budget: int) -> list[Trie]:
    """Every pair within ``budget`` bits is within the limits of one of these."""
    upper = budget // 2
    lower = budget - upper - 1
    return [Trie(0, 0, ((BITS // 2, upper), (BITS, budget)))] + ([Trie(0, BITS // 2, ((BITS // 2, lower), (BITS, budget)))] if lower >= 0 else [])


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v) fingerprints that connect the rows of ``distinct`` (column fp) within ``budget`` bits."""
    nodes = distinct.select(F.col("fp").alias("node"), F.col("fp").alias("word"))
    return joined(nodes, tries_of(budget), ["word"], thin=True, min_depth=MIN_DEPTH)


def near_duplicates(df: DataFrame, width: int = 4, budget: int = BUDGET, min_jaccard: float | None = None, doc_id: str = "doc_id", text: str = "text", result: str = "component_id") -> DataFrame:
    """``df`` without its text, with ``fp`` (long), ``body`` (a hash of the text), ``class`` (the smallest fingerprint of
    the row's class) and ``component_id`` (the smallest id of the row's class).

    With ``min_jaccard``, rows are linked if their texts share at least that of their distinct shingles (``budget`` does not
    matter); ``fp`` is then a name of the set of shingles.
    """
    from tidemark.llm.alike import WORDS, similar_links, sketched

    source = df.drop("fp", "body", "class", result).withColumn("body", F.xxhash64(F.col(text)))
    marked = materialize(fingerprints(source, width, text) if min_jaccard is None else sketched(source, width, text, "fp"), "fingerprints")
    # Copies collapse here; the partial minimum keeps a fingerprint that a third of all rows share cheap.
    least = [F.min(F.col(doc_id).cast("long")).alias("first_id")]
    if min_jaccard is not None:
        least += [F.min(F.struct(doc_id, "body")).alias("row"), *(F.min(w).alias(w) for w in WORDS)]
    distinct = materialize(marked.groupBy("fp").agg(*least), "distinct-fingerprints")
    links = fingerprint_links(distinct, budget) if min_jaccard is None else similar_links(distinct, source, doc_id, text, width, min_jaccard)
    classes = connected_components(links)
    member = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class"))
    member = materialize(member, "fingerprint-classes")
    names = member.groupBy("class").agg(F.min("first_id").alias(result))
    named = member.join(names, "class").select(F.col("fp").alias("__fp"), "class", result)
    return marked.drop(*WORDS).join(named, marked["fp"] == named["__fp"]).drop("__fp")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class: that of the smallest id (rows with an id go first), then text hash."""
    found = near_duplicates(df.select(doc_id, text), doc_id=doc_id, text=text, **options)
    first = found.groupBy("class").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "body")).alias("k"))
    stay = first.select(F.col("k.id").alias("__id"), F.col("k.body").alias("__body"))
    marked = df.withColumn("__b", F.xxhash64(F.col(text)))
    joined = marked.join(stay, marked[doc_id].eqNullSafe(stay["__id"]) & (marked["__b"] == stay["__body"]), "left_semi")
    return joined.dropDuplicates([doc_id, "__b"]).drop("__b")


def document_classes(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
