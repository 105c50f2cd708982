"""Paper recommendation: choose a source, drop repeats, grow the index, search, filter, present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators import bm25, papers
from ragspark.operators.embedding import Embedder
from ragspark.operators.requests import label_outcomes
from ragspark.sources.tables import insert_if_absent, stored


def paper_index(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """Index rows of papers: identifier, text, vector and cleaned metadata."""
    texts = papers.paper_text(rows.withColumn("paper_id", papers.paper_key()))
    return embedder(papers.clean_metadata(texts), "text", "embedding").select(
        "paper_id", "text", "embedding", *papers.PAPER)


def collect_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows ``(query_id, pos, paper columns)`` of the source that answered, one per title."""
    return papers.dedupe_titles(papers.with_source_fallback(first, second))


def grow_index(candidates: DataFrame, path: str, embedder: Embedder) -> DataFrame:
    """Adds candidates the index lacks and returns the index table; only those are embedded."""
    keyed = candidates.withColumn("paper_id", papers.paper_key())
    insert_if_absent(keyed, path, "paper_id", lambda fresh: paper_index(fresh, embedder))
    return stored(candidates.sparkSession, path)


def recommend_papers(
    queries: DataFrame, index_table: DataFrame, embedder: Embedder, k: int = 5, kind: str = "all",
    search_index: bm25.Bm25Index | None = None,
) -> DataFrame:
    """Papers per query from the index: hybrid search, access filter, cut to k, presentation."""
    search_index = search_index or bm25.build_index(index_table, "paper_id")
    asked = embedder(queries, "query", "embedding")
    found = papers.hybrid_search(asked, index_table, search_index)
    return papers.present(papers.access_filter(found, kind), max(1, min(int(k), 20)))


def answer_queries(
    queries: DataFrame, first: DataFrame, second: DataFrame, path: str, embedder: Embedder | None, k: int = 5,
    kind: str = "all",
) -> DataFrame:
    """The whole flow: rows of two sources to papers shown, with the index at ``path`` growing on the way.

    Without an embedder, the sources' own order decides among each query's papers.
    """
    if embedder is None:
        plain = papers.plain_ranking(collect_candidates(first, second))
        return papers.present(papers.access_filter(plain, kind), max(1, min(int(k), 20)))
    return recommend_papers(queries, grow_index(collect_candidates(first, second), path, embedder), embedder, k, kind)


def outcomes(queries: DataFrame, shown: DataFrame) -> DataFrame:
    return label_outcomes(queries, shown).withColumn(
        "message",
        F.when(F.col("status") == "no_results", "No journals found matching your query.")
        .otherwise("Journal recommendations fetched successfully"),
    )
