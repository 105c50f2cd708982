"""Requests and responses: validation, routing, session values, errors, summaries and outcome labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions.text import filled


def check_queries(queries: DataFrame) -> DataFrame:
    """Adds ``valid``, ``sanitized``, ``message`` and ``unusual`` for each query."""
    return queries.withColumn("_c", sc.query_check(F.col("query"))).select("*", "_c.*").drop("_c")


def route_requests(requests: DataFrame) -> DataFrame:
    """Status of ``(query_id, query, book)`` requests; faulty ones become error rows with confidence 0."""
    query, book = filled(F.col("query")), filled(F.col("book"))
    error = (
        F.when(query.isNull(), "malformed input: query_text must be a non-empty string")
        .when(book.isNull(), "missing book selection")
    )
    return requests.select(
        "query_id",
        query.alias("query"),
        book.alias("book"),
        F.when(error.isNull(), "ok").otherwise("error").alias("status"),
        error.alias("error"),
        F.when(error.isNotNull(), F.lit(0.0)).alias("confidence"),
    )


def active_book(scans: DataFrame, by: str, value: str, ts: str, tie: str) -> DataFrame:
    """Most recent value per key. One row per key and task is shuffled."""
    return scans.groupBy(by).agg(F.max_by(value, F.struct(ts, tie)).alias("active_book"))


def resolve_book(requests: DataFrame, sessions: DataFrame, by: str) -> DataFrame:
    """First non-empty of book_ref, book_uid, uid and the session's active book."""
    blank = F.lit("")
    choices = [F.nullif(F.col(c), blank) for c in ("book_ref", "book_uid", "uid")]
    joined = requests.join(sessions.select(by, "active_book"), by, "left")
    return joined.withColumn("book", F.coalesce(*choices, F.col("active_book")))


def error_code(message: Column) -> tuple[Column, Column]:
    """Error code and type of a message, by the first fragment it contains."""
    lowered = F.lower(F.coalesce(message, F.lit("")))
    code, kind = F, F
    for fragment, name, group in fv.ERROR_FRAGMENTS:
        code = code.when(F.contains(lowered, F.lit(fragment)), name)
        kind = kind.when(F.contains(lowered, F.lit(fragment)), group)
    return code.otherwise(fv.OTHER_ERROR), kind.otherwise(fv.OTHER_ERROR)


def classify_errors(errors: DataFrame, message: str = "message") -> DataFrame:
    """Adds error code, error type, status number and summary."""
    code, kind = error_code(F.col(message))
    coded = errors.withColumns({"error_code": code, "error_type": kind})
    status, text = F, F
    for name, number, words in fv.ERROR_STATUS:
        status = status.when(F.col("error_code") == name, number)
        text = text.when(F.col("error_code") == name, words)
    return coded.withColumns({
        "status_code": status.otherwise(fv.OTHER_STATUS[0]), "error_summary": text.otherwise(fv.OTHER_STATUS[1])})


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_code", "error_type", "status_code", "error_summary").agg(F.count("*").alias("rows"))


def retrieval_summary(hits: DataFrame, model: str, threshold: float = fv.PASSAGE_SIMILARITY) -> DataFrame:
    """Per query: number of hits, best similarity (which is also the confidence), threshold and model."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("total_results"),
        F.round(F.max("similarity"), 4).alias("top_similarity_score"),
    ).withColumns({
        "threshold_used": F.lit(threshold),
        "model_used": F.lit(model),
        "confidence": F.col("top_similarity_score"),
    })


def label_outcomes(queries: DataFrame, hits: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per query, rows or not: ``(query_id, status, total, message)``.

    ``errors`` holds ``(query_id, message)`` of queries that were turned away.
    """
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.select("query_id").join(counts, "query_id", "left")
    if errors is None:
        rows = rows.withColumn("_error", F.lit(None).cast("string"))
    else:
        rows = rows.join(errors.select("query_id", F.col("message").alias("_error")), "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "query_id",
        F.when(F.col("_error").isNotNull(), "error").when(n == 0, "no_results").otherwise("ok").alias("status"),
        F.when(F.col("_error").isNotNull(), F.lit(0)).otherwise(n).alias("total"),
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(n == 0, "No results found matching your query.")
        .otherwise("Recommendations fetched successfully").alias("message"),
    )
