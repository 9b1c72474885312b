"""The corpus pipeline: toxic documents go, one near copy of each group stays, benchmark passages go, secrets are masked, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm.common import stored
from palimp.llm.decontam import without_benchmark
from palimp.llm.ngram_join import one_of_each
from palimp.llm.packing import pack
from palimp.llm.secrets import masked
from palimp.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; owner-specific live-looking credentials are masked in their texts, and n_chars follows."""
    return masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


STAGES = [("toxicity", toxicity), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", packing)]

#: SQL can't express the classifier, MinHash pruning or the tokeniser; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
