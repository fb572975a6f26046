"""One query per operator, over its whole table with production parameters, and SQL where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capsite.llm import ann, bpe, jaccard_join, license_scan, packing, quality_rules, rlz_dedup, suffix_dedup, token_counts, url_filter


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A public tokenizer file, from a folder or from where the package of these files has it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"), tokenizer=tokenizer_file("byte_bpe_50k.json", tokenizers))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents")).select("doc_id", *quality_rules.FIELDS, "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "copy_id", "n_copies", "class_id", "n_links")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model", tokenizers))


def op8_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.digest(_read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return bpe.bpe_round_trip(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json", tokenizers))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, url_filter.registered_list(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_quality_rules, op4_suffix_dedup, op5_jaccard_join, op6_nearest, op7_token_counts, op8_rlz_dedup, op9_bpe, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force in tests/llm."""
    return {"op3_quality_rules": quality_rules.ORACLE, "op10_url_filter": url_filter.ORACLE}
