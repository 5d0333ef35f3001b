"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of ``documents``:

1. documents that a quality rule rejects go;
2. of every group of near-duplicates (5-word shingle sets of Jaccard similarity 0.8 or more, directly or through others) the
   document with the smallest id stays;
3. passages of the benchmark are cut out of the text; a document that is mostly such passages goes;
4. secrets in the text are replaced by the name of their kind;
5. per document: number of tokens, digests of token ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm import decontaminate, pieces, quality, secrets, shingles
from segstats.session import materialize


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage may have changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recount(decontaminate.decontaminate(docs, items))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(secrets.redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", encoding),
]
#: No SQL: the tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
