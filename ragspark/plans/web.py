"""Web context: validate, chunk, score, prune, rerank, budget, prompt - for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.operators import context, quality
from ragspark.operators.chunking import chunk_results
from ragspark.operators.dedupe import prune_near_duplicates
from ragspark.operators.embedding import Embedder, Scorer, hashing_embedder, lexical_scorer
from ragspark.operators.rerank import rerank, score_chunks
from ragspark.session import cut_lineage

# Chunk order within a query: result position first, then the chunk's place in its result, which is a 32-bit number.
PARTS_PER_RESULT = 1 << 31


def query_table(results: DataFrame) -> DataFrame:
    return results.select("query_id", "query").distinct()


def keyed_chunks(filtered: DataFrame) -> DataFrame:
    key = F.col("pos").cast("long") * PARTS_PER_RESULT + F.col("part")
    return chunk_results(filtered).withColumn("chunk_key", key)


def scored_chunks(filtered: DataFrame, queries: DataFrame, embedder: Embedder, threshold: float) -> DataFrame:
    scored = score_chunks(keyed_chunks(filtered), queries, embedder, threshold)
    return scored.select(
        "query_id", "chunk_key", "source", "chunk_text", "tavily_score", "token_estimate", "similarity", "embedding")


def pruned_chunks(scored: DataFrame, threshold: float = fv.NEAR_DUPLICATE_COSINE) -> DataFrame:
    order = [-F.col("similarity"), F.col("chunk_key")]
    return prune_near_duplicates(scored, order, key="chunk_key", threshold=threshold)


def web_context(
    results: DataFrame,
    embedder: Embedder | None = None,
    scorer: Scorer = lexical_scorer,
    similarity: float = fv.CHUNK_SIMILARITY,
) -> DataFrame:
    """Final context blocks ``(query_id, mode, block, text, source, confidence)`` of search results.

    Queries, scored chunks and the few reranked ones are materialised in the shared checkpoint folder, because the steps after
    them read them several times.
    """
    embedder = embedder or hashing_embedder()
    queries = cut_lineage(query_table(results))
    filtered = quality.filter_with_fallback(results)
    scored = cut_lineage(scored_chunks(filtered, queries, embedder, similarity))
    reranked = cut_lineage(rerank(pruned_chunks(scored).drop("embedding"), queries, scorer))
    return context.final_context(reranked)


def web_prompts(results: DataFrame, **options) -> DataFrame:
    return context.web_prompt(query_table(results), web_context(results, **options))
