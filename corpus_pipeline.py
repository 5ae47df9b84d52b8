"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of ``documents``; the last one
returns the packed pieces.

Defined cases: rows of a null or empty text go in the first stage; rows of a null or repeated id are rows like any other, told apart by
their texts where a stage drops some of them (of wholly equal rows one stays); a missing language is filled in; other columns are
dropped; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import drop_leaking
from tidemark.llm.langid import UND, identify, train
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.simhash import keep_one
from tidemark.llm.vocabulary import vocabulary_path
from tidemark.runtime import delete_path, dropping_scratch, scratch_path, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5  # of the predicted language's posterior

#: The stages are statistical or iterative; they are tested against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts whose best language is not the likely one; name missing languages."""
    model = train(docs, vocabulary_path("piece_bpe_32k.model"))
    found = identify(docs, model, lang_pred="__lang", score="__score")
    kept = found.filter((F.col("__lang") != UND) & (F.col("__score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that at least three documents hold, but for the last of those."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return keep_one(docs, width=5, min_jaccard=0.8).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences."""
    return pack(docs, vocabulary_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with dropping_scratch(spark):  # what a stage writes on its way goes when its result is there
            docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
