"""Corpus pipeline over ``documents``: stages that are written as Parquet and read again by the next.

Every stage takes what its predecessor kept. All but the last return the columns of ``documents``; the last
writes the token files and returns a row for each document in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm._store import shared_folder, stored
from thicket.llm.decontaminate import without_leaks
from thicket.llm.jaccard_join import representatives
from thicket.llm.mixing import mixed
from thicket.llm.quality import kept
from thicket.llm.token_files import token_table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of ``NEAR_WORDS`` words to a shingle are
    alike by ``NEAR_PERCENT`` in a hundred or more. ``op6_jaccard_join`` has a rule of its own."""
    return representatives(docs, NEAR_WORDS, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak an item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def token_binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token files."""
    return token_table(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_target_weights", mixing_to_target_weights),
    ("token_binary_output", token_binary_output),
]

#: The classifier's model and the tokenizer are beyond SQL; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored below ``spark.checkpoint.dir``."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
