"""The thin queries of this package, by name, and SQL for those that have any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alluvia.llm import bitsliced, bpe, decontaminate, fingerprints, language, licences, minhash, sharding, toxicity, warc
from alluvia.llm.oracle import ORACLE_SQL
from alluvia.storage import Scratch

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_archives(warc.classify(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch=scratch), scratch.path("archives"))
    warc.write_store(warc.read_archives(spark, scratch.path("archives")), scratch.path("store"))
    scratch.drop("archives", "again", "filter")
    return warc.rebuilt(spark, scratch.path("store"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(language.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = language.learn(docs.filter(~held_out))
    return language.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_warc": op1_warc, "op2_toxicity": op2_toxicity, "op3_topk": op3_topk, "op4_bpe": op4_bpe, "op5_substrings": op5_substrings, "op6_decontaminate": op6_decontaminate, "op7_language": op7_language, "op8_minhash": op8_minhash, "op9_licences": op9_licences, "op10_sharding": op10_sharding}
