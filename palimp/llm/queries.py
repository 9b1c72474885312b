"""The corpus operators as registered queries: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.llm import oracles
from palimp.llm.ann import neighbours
from palimp.llm.decontam import decontaminate
from palimp.llm.html_main import extract
from palimp.llm.licenses import licenses
from palimp.llm.ngram_join import similar
from palimp.llm.packing import pack
from palimp.llm.repeats import remove_repeats
from palimp.llm.secrets import secrets
from palimp.llm.token_counts import token_counts
from palimp.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def packing_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document whether its pieces hold each id once, and stand in sequences that are gapless and full or a power of two."""
    rows = op9_packing(spark, sf_dir)
    before = lambda key, order: F.coalesce(F.sum("length").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before("doc_id", "start")).withColumn("filled", before("sequence_id", "offset")).withColumn("total", F.sum("length").over(Window.partitionBy("sequence_id")))
    good = (F.col("filled") == F.col("offset")) & (F.col("total") <= 1024) & (F.col("total").bitwiseAND(F.col("total") - 1) == 0)
    per = rows.groupBy("doc_id").agg(F.bool_and((F.col("before") == F.col("start")) & (F.col("length") > 0)).alias("in_order"), F.sum("length").alias("tokens"), F.max("doc_tokens").alias("said"), F.bool_and(good).alias("sequences"))
    return per.select("doc_id", (F.col("in_order") & (F.col("tokens") == F.col("said"))).alias("whole"), "sequences")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_licenses, op3_ngram_join, op4_secrets, op5_token_counts, op6_repeats, op7_neighbours, op8_decontamination, op9_packing, op10_html)
    return {f.__name__: f for f in (*ops, packing_contract)}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the classifier, the tokeniser, the index and HTML are tested against plain versions instead, the packer by what its contract says of every document."""
    return {"packing_contract": "SELECT doc_id, TRUE AS whole, TRUE AS sequences FROM documents", "op2_licenses": oracles.licenses(), "op3_ngram_join": oracles.ngram_join(), "op4_secrets": oracles.secrets(), "op6_repeats": oracles.repeats(), "op8_decontamination": oracles.decontamination()}
