"""A training-data pipeline over documents: five operators in a row, each written as Parquet and read again.

1. toxicity: documents that are predicted toxic go.
2. near_dedup: of each group linked by a five-word Jaccard similarity of 0.8 or more the document with the smallest doc_id
   stays; links are met in the SimHash popcount grid, those beyond its radius by shared shingles.
3. substring_dedup: words covered by 20-word windows that start earlier in the corpus are removed from the texts.
4. decontamination: documents that overlap a benchmark item go.
5. packing: what is left is tokenized and packed into sequences; one row a piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import decontamination, near_copies, packing, substring_dedup, toxicity
from sievewright.llm.common import Stage
from sievewright.llm.tokenizer_files import tokenizer_path

#: Model scores, components and packing are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(spark, docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("decontamination", _decontamination),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.keep(step(spark, docs, sf_dir), name)
        if k:
            stage.drop(STAGES[k - 1][0])
    return docs
