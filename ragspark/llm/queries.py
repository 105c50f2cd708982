"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import alignment, conversations, decontamination, exact_dedup, jaccard, licenses, near_vectors, packing, quality, secret_scan, substrings, token_counts, warc
from ragspark.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), tokenizer_path())


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), tokenizer_path())


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, folder, "documents"))


def document_files(docs: DataFrame) -> DataFrame:
    """Every document as a file: its source is the root; numbers give up to two levels of directories below it."""
    number = F.col("doc_id")
    upper, lower = (F.expr(f"cast(doc_id div {n} as string)") for n in (5000, 50))
    folder = (F.when(number % 100 == 0, F.col("source")).when(number % 10 == 0, F.concat_ws("/", "source", upper))
              .otherwise(F.concat_ws("/", "source", upper, lower)))
    return docs.select("doc_id", "text", F.concat_ws("/", folder, number.cast("string")).alias("path"))


def op5_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licences(document_files(read(spark, folder, "documents")))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, folder, "documents")).drop("masked_text")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives every page and reads the archives back; revisits take length and digest from their headers."""
    where = warc.archive_folder(spark)
    warc.archive_pages(read(spark, folder, "pages"), where)
    return warc.page_report(spark, where)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return quality.score_quality(docs, quality.fit(docs, read(spark, folder, "labels")))


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(read(spark, folder, "documents")).drop("removed_spans")


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(read(spark, folder, "embeddings")).drop("audited_recall")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(read(spark, folder, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, folder, "documents"))


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations")
    return conversations.repair(conversations.damaged(rows), all_ids=rows)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_licence_scan": op5_licence_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_near_vectors": op10_near_vectors,
    "op11_alignment": op11_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversations": op13_conversations,
}
ORACLES: dict[str, str] = {"op5_licence_scan": licenses.ORACLE, "op9_substrings": substrings.ORACLE,
                           "op10_near_vectors": near_vectors.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE}
