"""Validation of web results ``(query_id, query, pos, url, score, content)``.

Everything is decided inside the row, cheapest test first. Only the empty-result fallback looks across rows, and it
needs no more than the distinct ids of queries that kept something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.session import cut_lineage


def reject_reason() -> Column:
    """First failing test of a row, null when it passes all of them."""
    score = F.col("score").try_cast("double")
    content = F.col("content")
    return (
        F.when(F.col("url").isNull() | content.isNull() | F.col("score").isNull(), "missing_field")
        .when(score.isNull(), "bad_score")
        .when(score < fv.MIN_RESULT_SCORE, "low_score")
        .when(F.length(tx.strip(content)) < fv.MIN_CONTENT_CHARS, "short_content")
        .when(~tx.has_structure(content), "no_structure")
        .when(tx.keyword_hits(content, tx.query_keywords(F.col("query"))) < fv.MIN_KEYWORD_HITS, "no_keyword")
        .when(tx.pronoun_ratio(content) > fv.MAX_PRONOUN_RATIO, "conversational")
    )


def _coarse() -> Column:
    score = F.col("score").try_cast("double")
    return (
        F.col("url").isNotNull()
        & F.col("content").isNotNull()
        & (score >= fv.MIN_RESULT_SCORE)
        & (F.length(tx.strip(F.col("content"))) >= fv.MIN_CONTENT_CHARS)
    )


def _fine() -> Column:
    content = F.col("content")
    return (
        tx.has_structure(content)
        & (tx.keyword_hits(content, tx.query_keywords(F.col("query"))) >= fv.MIN_KEYWORD_HITS)
        & (tx.pronoun_ratio(content) <= fv.MAX_PRONOUN_RATIO)
    )


def coarse_valid(results: DataFrame) -> DataFrame:
    """Rows that have all fields, enough score and enough content."""
    return results.where(_coarse())


def fine_valid(results: DataFrame) -> DataFrame:
    """Rows with structure, a query keyword and a factual tone."""
    return results.where(_fine())


def strict_filter(results: DataFrame) -> DataFrame:
    return fine_valid(coarse_valid(results))


def rejection_audit(results: DataFrame) -> DataFrame:
    """Rows per query and first failing test; partial counts before the shuffle."""
    reason = F.coalesce(reject_reason(), F.lit("kept"))
    return results.groupBy("query_id", reason.alias("reason")).agg(F.count("*").alias("rows"))


def judged(results: DataFrame) -> DataFrame:
    """Strictly valid rows and those a fallback could take, told apart by ``_strict``. The outer generator keeps Spark
    from testing a row a second time in a pushed filter."""
    verdict = F.when(_coarse() & _fine(), F.array(F.lit(True))).when(
        F.col("pos") < fv.FALLBACK_ROWS, F.array(F.lit(False)))
    return results.select("*", F.explode_outer(verdict).alias("_strict")).where(F.col("_strict").isNotNull())


def filter_with_fallback(results: DataFrame) -> DataFrame:
    """Strictly valid rows; a query that keeps none takes its first three raw rows instead.

    Every text is read and tested once: rows that may stay are stored with their verdict in the shared checkpoint
    folder. Kept rows are not shuffled. The fallback joins at most three short-listed rows per query with the distinct
    ids of queries that kept something, so a query with very many rows costs no more than any other.
    """
    able = cut_lineage(judged(results))
    kept = able.where(F.col("_strict")).drop("_strict")
    served = kept.select("query_id").distinct()
    spare = able.where(~F.col("_strict")).drop("_strict").join(served, "query_id", "left_anti")
    spare = spare.withColumns({
        "url": F.coalesce("url", F.lit("")),
        "score": F.coalesce("score", F.lit(0).cast(results.schema["score"].dataType)),
        "content": F.coalesce("content", F.lit("")),
    })
    return kept.unionByName(spare)
