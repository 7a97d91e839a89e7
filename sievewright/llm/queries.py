"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, fingerprints, license_scan, lm_scoring, packing, simhash, substring_dedup, token_counts, toxicity
from .tokenizer_files import tokenizer_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, _docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_digests(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(spark, _docs(spark, sf_dir)).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _docs(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, _docs(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, _docs(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(spark, _docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_decontamination": op3_decontamination,
        "op4_chat_format": op4_chat_format,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_simhash": op6_simhash,
        "op7_license_scan": op7_license_scan,
        "op8_fingerprints": op8_fingerprints,
        "op9_toxicity": op9_toxicity,
        "op10_lm_scoring": op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {}
