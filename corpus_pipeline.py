"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame; ``run`` writes each
stage's rows as Parquet below the shared checkpoint folder and reads them again for the next. All stages but the last
return the columns of ``docs``, extra ones included. The stages that drop documents judge each row by its own text: rows with
no id, or with the id of another row, go and stay like all others. Null and empty texts and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ragspark.llm import decontamination, jaccard, packing, quality, secret_scan
from ragspark.llm.common import read, stored
from ragspark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.good_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays, that with the smallest id, nulls last."""
    return jaccard.unique_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked, and ``n_chars`` follows."""
    return secret_scan.mask_secrets(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Neither a trained classifier nor a tokenizer can be put in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
