"""Book recommendation: by vector with a threshold, or by keyword overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.operators import keywords, ranking, requests, vectors

SHOWN = ["title", "author", "category", "summary"]


def recommend_by_vector(queries: DataFrame, books: DataFrame, threshold: float = fv.BOOK_SIMILARITY, **options):
    """Books similar enough to each valid query.

    ``queries``: query_id, query, top_k, embedding of the sanitized query. ``books``: book_id, embedding, title,
    author, category, summary. The k nearest are found first and filtered then, so fewer than k may stay.
    """
    checked = requests.check_queries(queries).where("valid").withColumn("k", sc.book_top_k(F.col("top_k")))
    hits = vectors.nearest(checked, books, fv.MAX_TOP_K, corpus_key="book_id", **options)
    cut = hits.join(checked.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    near = cut.where(F.col("similarity") >= threshold).drop("rank", "k")
    numbered = ranking.top_k(near, ["query_id"], [F.desc("similarity"), F.asc("book_id")], fv.MAX_TOP_K)
    unknown = [F.coalesce(c, F.lit("Unknown")).alias(c) for c in SHOWN[:3]]
    return numbered.join(books.select("book_id", *unknown, "summary"), "book_id").select(
        "query_id", "rank", "book_id", *SHOWN,
        F.round("similarity", 4).alias("similarity_score"),
        sc.percent(F.col("similarity")).alias("match_percentage"),
    )


def recommend_by_keyword(queries: DataFrame, catalog: DataFrame, k: int = fv.DEFAULT_TOP_K) -> DataFrame:
    """Books that contain most of the query's terms, scored relative to the query's best book."""
    k = max(1, min(k, fv.MAX_PAPER_TOP_K))
    ranked = keywords.overlap_ranking(queries, catalog, k)
    scored = ranking.relative_score(ranked, "score").withColumn(
        "match_percentage", F.round(F.col("similarity_score") * 100, 2))
    return scored.join(catalog.select("book_id", *SHOWN), "book_id").select(
        "query_id", "rank", "book_id", *SHOWN, "score", "similarity_score", "match_percentage")


def outcomes(queries: DataFrame, hits: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Status of every query, valid or not.

    A valid query whose hits all fall below the threshold is ``ok`` with an empty list. With ``books``, the searched
    table, a valid query has ``no_results`` if that table is empty.
    """
    checked = requests.check_queries(queries)
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    empty = F.lit(False) if books is None else books.limit(1).agg(F.count("*")).scalar() == 0
    rows = checked.join(counts, "query_id", "left").withColumn("_empty", empty)
    return rows.select(
        "query_id",
        F.when(~F.col("valid"), "error").when(F.col("_empty"), "no_results").otherwise("ok").alias("status"),
        n.alias("total"),
        F.when(~F.col("valid"), F.col("message"))
        .when(F.col("_empty"), F.concat(F.lit("No books found matching '"), "sanitized", F.lit("'. Try a different query.")))
        .when(n == 0, "No recommendations found")
        .otherwise("Recommendations fetched successfully").alias("message"),
    )


def keyword_outcomes(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Status of every keyword query; a null query counts as one without words."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.join(counts, "query_id", "left").select(
        "query_id",
        F.when(n == 0, "no_results").otherwise("ok").alias("status"),
        n.alias("total"),
        F.when(tx.filled(F.col("query")).isNull(), "Please provide a meaningful query.")
        .when(n == 0, "No books found matching your query.")
        .otherwise("Recommendations fetched successfully (fallback mode)").alias("message"),
    )
