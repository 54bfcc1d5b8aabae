"""A corpus pipeline: language, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. What a
stage decides takes effect: documents go, or their text changes (then n_chars follows).

Rows whose doc_id is null have no identity and stay until another rule drops them; of rows that repeat both doc_id and text, one stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alluvia.llm import bpe, decontaminate, fingerprints, language, minhash
from alluvia.storage import Scratch, give_back

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts that are less like every language than this are rejected; running text scores 0.4 and more, letters at random below 0.2.
LEAST_LIKE_A_LANGUAGE = 0.25


def fresh(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that begins when executors have given back what the one before has left: their heaps only grow otherwise, beside Python workers that need room."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@fresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts like no language; a missing lang becomes the predicted one."""
    profiles = language.learn(docs)
    named = language.predict(docs, profiles, keep=COLUMNS)
    unsure = (F.col("lang_pred") == "und") | (F.col("score") < LEAST_LIKE_A_LANGUAGE)
    # without any profile nothing can be told apart, so only texts without a letter go
    reject = unsure if profiles else ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return named.filter(~reject).withColumn("lang", F.when(F.col("lang_pred") == "und", F.col("lang")).otherwise(F.coalesce("lang", "lang_pred"))).select(*COLUMNS)


@fresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group (five-word shingles, similarity 0.8 or more) and all without words."""
    return minhash.deduplicated(docs.select(*COLUMNS), k=5)


@fresh
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words covered by 13-word windows that start in an earlier document; documents with nothing left go."""
    marked = fingerprints.mark(docs.select(*COLUMNS), keep_text=True)
    text = F.col("text")
    changed = F.col("n_removed") > 0
    out = marked.filter(~(changed & (F.length(F.trim(F.coalesce(text, F.lit("")))) == 0)))
    return out.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@fresh
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an eight-word window of a benchmark item occurs, whether or not the item has an id."""
    hit = decontaminate.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hit.filter(F.col("hit_bits").isNull()).select(*COLUMNS)


@fresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs


#: Language identification is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
