"""Scoring of chunks against their query, and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.functions import vectors as vx
from ragspark.operators.embedding import Embedder, Scorer
from ragspark.operators.ranking import similar_enough, top_k


def score_chunks(
    chunks: DataFrame, queries: DataFrame, embedder: Embedder, threshold: float = fv.CHUNK_SIMILARITY
) -> DataFrame:
    """Chunks of each query with their cosine similarity to it, those below the threshold left out.

    Each chunk meets one query, its own. The query side has one row per query; Spark broadcasts it if it is small and
    splits hot queries if it is not.
    """
    asked = embedder(queries.select("query_id", "query"), "query", "_qv").select("query_id", "_qv")
    embedded = embedder(chunks, "chunk_text", "embedding")
    both = embedded.join(asked, "query_id")
    scored = both.withColumn("similarity", F.round(vx.cosine(F.col("_qv"), F.col("embedding")), 9)).drop("_qv")
    return similar_enough(scored, threshold)


def rerank(
    chunks: DataFrame, queries: DataFrame, scorer: Scorer, k: int = fv.RERANK_TOP_K
) -> DataFrame:
    """Best k chunks per query by score minus penalty; ties keep the order of similarity and position."""
    scored = chunks.join(queries.select("query_id", "query"), "query_id")
    value = F.round(scorer(F.col("query"), F.col("chunk_text")) - tx.answer_penalty(F.col("chunk_text")), 4)
    order = [F.desc("rerank_score"), F.desc("similarity"), F.asc("chunk_key")]
    return top_k(scored.withColumn("rerank_score", value).drop("query"), ["query_id"], order, k)
