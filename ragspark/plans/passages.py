"""Book passages: offline indexing of whole texts, and retrieval from the book a request names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.operators import catalog, ranking, requests, vectors
from ragspark.operators.chunking import split_book
from ragspark.operators.embedding import Embedder
from ragspark.session import cut_lineage
from ragspark.sources.files import valid_chunks
from ragspark.sources.tables import retrieval_records, write_collections


def book_vectors(books: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunk vectors ``(book_uid, chunk_id, document, embedding)`` of ``(book_uid, text)`` rows."""
    cleaned = books.select("book_uid", tx.clean_text(F.col("text")).alias("text"))
    chunks = valid_chunks(split_book(cleaned).select("book_uid", "chunk_id", "text")).where(F.col("reason").isNull())
    ready = chunks.withColumn("_input", tx.collapse_whitespace(F.col("text")))
    return embedder(ready, "_input", "embedding").select(
        "book_uid", "chunk_id", F.col("text").alias("document"), "embedding")


def index_books(books: DataFrame, embedder: Embedder, path: str) -> DataFrame:
    """Writes the collections of the given books and reports on what was written."""
    write_collections(book_vectors(books, embedder), path)
    written = books.sparkSession.read.parquet(path).join(books.select("book_uid").distinct(), "book_uid", "left_semi")
    return vectors.embedding_report(written, ["book_uid"])


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Query vectors; the instruction prefix belongs to the query side only."""
    return embedder(queries.withColumn("_input", F.concat(F.lit(fv.QUERY_PREFIX), "query")), "_input", "embedding") \
        .drop("_input")


def best_passages(queries: DataFrame, collections: DataFrame, k: int = fv.PASSAGE_TOP_K, **options) -> DataFrame:
    """Top k chunks of the query's own book, ranked, for queries whose best hit passes the gate.

    ``queries``: query_id, book_uid, embedding. ``collections``: book_uid, chunk_id, embedding and ``document``.
    """
    hits = vectors.nearest(queries, collections, k, scope=["book_uid"], corpus_key="chunk_id", **options)
    gated = ranking.top_hit_gate(hits)
    return gated.join(queries.select("query_id", "book_uid"), "query_id")


def retrieve(requests_table: DataFrame, collections: DataFrame, titles: DataFrame, embedder: Embedder, model: str,
             now: Column) -> tuple[DataFrame, DataFrame]:
    """Answers ``(query_id, query, book)`` requests: one outcome row per request, and one record per answered one.

    Faulty requests, unknown books, vectors of the wrong dimension and queries without a relevant hit become error
    rows.
    """
    routed = requests.route_requests(requests_table)
    asked = routed.where(F.col("status") == "ok").select("query_id", "query", F.col("book").alias("book_uid"))
    embedded = cut_lineage(embed_queries(asked, embedder))  # read several times; the model runs once
    checked = vectors.dimension_check(embedded, collections, "book_uid")
    hits = best_passages(embedded, collections)
    full = hits.join(collections.select("book_uid", "chunk_id", "document"), ["book_uid", "chunk_id"])
    summary = requests.retrieval_summary(full, model)
    outcome = (
        routed.drop("confidence")
        .join(checked.select("query_id", F.col("status").alias("check")), "query_id", "left")
        .join(summary.select("query_id", "total_results", "confidence"), "query_id", "left")
    )
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("check") == "embeddings_missing", F.concat(F.lit("missing embeddings for book '"), "book", F.lit("'")))
        .when(F.col("check") != "ok", F.col("check"))
        .when(F.col("total_results").isNull(), F.lit("no sufficiently relevant content found"))
    )
    labelled = outcome.select(
        "query_id", F.col("book").alias("book_uid"),
        F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("total_results", F.lit(0)).alias("total_results"))
    named = catalog.resolve_titles(labelled, titles)
    records = retrieval_records(asked.withColumnRenamed("book_uid", "book"), full, summary, now)
    return named, records
