"""Queries over the training-data tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontam import find_leaks
from tidemark.llm.langid import document_languages
from tidemark.llm.lines import document_lines
from tidemark.llm.packing import pack
from tidemark.llm.quality import document_quality
from tidemark.llm.records import document_records
from tidemark.llm.secrets import document_secrets
from tidemark.llm.sharding import document_shards
from tidemark.llm.simhash import document_classes
from tidemark.llm.substrings import document_passages
from tidemark.llm.vocabulary import vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_secrets(_documents(spark, sf_dir), vocabulary_path())


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_classes(_documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_passages(_documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_records(_documents(spark, sf_dir), vocabulary_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), vocabulary_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": op1_secrets,
        "op2_lines": op2_lines,
        "op3_simhash": op3_simhash,
        "op4_substrings": op4_substrings,
        "op5_language": op5_language,
        "op6_records": op6_records,
        "op7_decontamination": op7_decontamination,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
    }


_STRIPPED = r"""translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

_OP2 = rf"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), e'\n')) AS line, unnest(range(len(string_split(coalesce(text, ''), e'\n')))) AS pos FROM documents),
k AS (SELECT *, {_STRIPPED} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id < f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lines": _OP2,
    }
