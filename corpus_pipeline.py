"""Corpus preparation in four stages: quality rules, one of each group of near copies, repeated passages, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capsite.llm import jaccard_join, packing, quality_rules, suffix_dedup
from capsite.llm.queries import tokenizer_file
from capsite.sources.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays."""
    return jaccard_join.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also start earlier are cut out of the texts."""
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the bins they go to."""
    return packing.best_fit_packing(docs, tokenizer=tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("suffix_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]
#: Suffix arrays and MinHash have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
