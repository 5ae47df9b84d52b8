"""Line dedup: levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, keeper) sorted by hash: how many documents of its batches hold the
line, and the largest id among them. It lies in two parts: the lines that are frequent by this run alone, and the rest. The documents come in
batches by id, the largest ids first, so that the keeper of a line is seen first. For each batch:

1. its distinct (document, line hash) pairs are counted per hash (partial counts first, so a line that a
   third of all documents hold is one row per task before the shuffle);
2. the batch merge-anti-joins the frequent parts of the runs: a hash that is known there, with a keeper
   above the batch's, needs no further entry. The rest of the runs is not read, so a batch costs what it holds, and what is frequent;
3. what is left is added as the batch's own level-0 run; when a level has ``fanout`` runs, they are
   compacted into one run of the next level (counts added, keepers maximised), and lines that have become frequent in it move to its
   frequent part. A row is rewritten once per level.

At the end all runs are merged once.

A line is frequent if ``min_docs`` documents hold it. Its lines are dropped everywhere but in the
largest document id that holds it. Line keys are hashed to 128 bits.

Defined cases: a null or empty text is one empty line; short lines are never dropped; repeated lines of
the keeper all stay; every row is a document, also one with an id that others have; a null id is smaller
than any other. Other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import delete_path, materialize, scratch_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)
RUN = "h1 long, h2 long, n_docs long, keeper long, frequent boolean"


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() on pure ASCII has a fast path and maps just A-Z; other lines take the exact table.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _line_hashes(text: Column, min_chars: int) -> Column:
    """One entry per line: its hash, or null if the key is too short to count."""

    def one(line: Column) -> Column:
        # A one-element transform binds the key, so that it is computed once.
        return F.transform(F.array(line_key(line)), lambda k: F.when(F.length(k) >= min_chars, _hash(k)))[0]

    return F.transform(_lines(text), one)


class LineRuns:
    """The levels of sorted runs, as Parquet tables in the shared folder."""

    def __init__(self, spark, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, run: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        # The aggregation has already dealt the rows by hash: sort in place, no further shuffle.
        split = run.withColumn("frequent", F.col("n_docs") >= self.min_docs)
        split.sortWithinPartitions("frequent", "h1", "h2").write.partitionBy("frequent").parquet(path)
        return path

    def _read(self, paths: list[str], frequent_only: bool = False) -> DataFrame:
        runs = [self.spark.read.schema(RUN).parquet(p) for p in paths]  # each run is the root of its own two parts
        rows = reduce(DataFrame.unionByName, runs)
        return rows.filter("frequent") if frequent_only else rows

    def known(self) -> DataFrame:
        """Lines that some run knows to be frequent: the only part of the runs that a batch reads."""
        return self._read(self.paths(), frequent_only=True).groupBy("h1", "h2").agg(F.max("keeper").alias("above"))

    def merged(self, paths: list[str] | None = None) -> DataFrame:
        """Runs as one."""
        return self._read(paths or self.paths()).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def frequent(self) -> DataFrame:
        return self.merged().filter(F.col("n_docs") >= self.min_docs)

    def left_of(self, hashes: DataFrame) -> DataFrame:
        """What a batch adds. ``hashes``: (doc, h) pairs, distinct in each document, of documents that no other batch holds."""
        batch = hashes.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        if not self.paths():
            return batch
        known = self.known().hint("merge")
        return batch.join(known, (batch.h1 == known.h1) & (batch.h2 == known.h2) & (known.above > batch.keeper), "left_anti")

    def add(self, hashes: DataFrame) -> None:
        self._place(0, self._write(self.left_of(hashes)))

    def _place(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._write(self.merged(full)))
            for old in full:
                delete_path(self.spark, old)


def batch_of(doc: Column, cuts: list[int]) -> Column:
    """The number of the document's batch: 0 has the largest ids."""
    return sum((F.when(doc <= cut, 1).otherwise(0) for cut in cuts), F.lit(0)).cast("int")


def line_runs(hashed: DataFrame, min_docs: int, batches: int) -> LineRuns:
    """Feed the batches in turn; ``hashed`` is a table partitioned by ``batch``."""
    runs = LineRuns(hashed.sparkSession, min_docs)
    for number in range(batches):
        runs.add(hashed.filter(F.col("batch") == number).select("doc", F.explode(_distinct(F.col("hs"))).alias("h")))
    return runs


def _distinct(hashes: Column) -> Column:
    """Distinct non-null hashes of one row: by sorting, since sets of structs would compare all pairs."""
    ordered = F.array(F.sort_array(F.filter(hashes, lambda h: h.isNotNull())))
    return F.transform(ordered, lambda s: F.filter(s, lambda h, i: (i == 0) | (h != F.get(s, i - 1))))[0]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, plus ``n_lines`` and ``n_dropped`` (long)."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    body = F.xxhash64(F.col(text))  # tells rows of one id apart
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in docs.select(doc.alias("doc")).approxQuantile("doc", shares, 0.01)}, reverse=True) if shares else []
    # The hashes of every line, once, by batch; what follows reads them and not the texts.
    path = scratch_path(spark, "line-hashes")
    made = docs.select(doc.alias("doc"), body.alias("body"), _line_hashes(F.col(text), min_chars).alias("hs")).withColumn("batch", batch_of(F.col("doc"), cuts))
    made.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(made.schema).parquet(path)
    frequent = materialize(line_runs(hashed, min_docs, len(cuts) + 1).frequent(), "frequent-lines")
    spots = hashed.select("doc", "body", F.posexplode("hs").alias("pos", "h")).filter("h IS NOT NULL").select("doc", "body", "pos", "h.h1", "h.h2")
    # A line that a third of all documents hold is a skewed key of this join; adaptive execution splits it.
    doomed = spots.join(frequent, ["h1", "h2"]).filter(F.col("doc") < F.col("keeper"))
    drops = doomed.groupBy("doc", "body").agg(F.collect_set("pos").alias("__drop"))
    kept = docs.drop("n_lines", "n_dropped").withColumns({"__doc": doc, "__body": body})
    joined = kept.join(drops, (kept["__doc"] == drops["doc"]) & (kept["__body"] == drops["body"]), "left").drop("doc", "body", "__doc", "__body")
    lines = F.array(_lines(F.col(text)))
    spared = F.transform(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drop")), lambda i: F.get(ls, i)))[0]
    intact = F.col("__drop").isNull()
    return joined.select(
        *(F.when(intact, F.col(c)).otherwise(F.array_join(spared, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size(_lines(F.col(text))).cast("long").alias("n_lines"),
        F.when(intact, 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )


def document_lines(docs: DataFrame) -> DataFrame:
    """Contract rows: counts and the digest of what stays."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
