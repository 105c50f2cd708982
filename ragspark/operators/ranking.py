"""Thresholds, top-k, budgets, pages and relative scores.

A ranking window is always limited to k, which Spark turns into a per-task limit before the shuffle
(``WindowGroupLimit``), so a query holding a large share of all rows sends only k rows per task. Orders end in a
unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with their 1-based rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def top_k_per_row(df: DataFrame, by: list[str], order: list[Column], k: str, most: int) -> DataFrame:
    """As ``top_k`` where each row carries its query's own k, which never exceeds ``most``."""
    return top_k(df, by, order, most).where(F.col("rank") <= F.col(k))


def similar_enough(df: DataFrame, threshold: float, similarity: str = "similarity") -> DataFrame:
    """Rows at or above the threshold, rounded after the comparison."""
    return df.where(F.col(similarity) >= threshold).withColumn(similarity, F.round(similarity, 4))


def by_similarity(df: DataFrame, similarity: str = "similarity", tie: str = "pos") -> DataFrame:
    """All rows ordered by query and falling similarity: a range sort, which splits a hot query over tasks."""
    return df.orderBy("query_id", F.desc(similarity), tie)


def top_hit_gate(ranked: DataFrame, threshold: float = fv.PASSAGE_SIMILARITY) -> DataFrame:
    """All rows of a query whose best hit reaches the threshold, none of the others (input: k rows per query)."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return ranked.withColumn("_best", best).where(F.col("_best") >= threshold).drop("_best")


def token_budget(
    chunks: DataFrame, order: list[Column], budget: int = fv.CONTEXT_TOKENS, tokens: str = "token_estimate"
) -> DataFrame:
    """Rows in order until the running token total would pass the budget, then none.

    ``order`` holds ascending expressions that together are unique per query. Of the rows with at least one token no
    more than ``budget`` fit, so only the first ``budget + 1`` per query and task are shuffled. Rows without tokens
    never fill the budget; they stay if they come before the row that breaks it.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = chunks.withColumns(dict(zip(keys, order)))
    w = Window.partitionBy("query_id").orderBy(*keys)
    heads = (
        keyed.where(F.col(tokens) > 0)
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= budget + 1)
        .withColumn("_used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    kept = heads.where(F.col("_used") <= budget).drop("_n", "_used")
    stops = heads.where(F.col("_used") > budget).groupBy("query_id").agg(F.min(F.struct(*keys)).alias("_stop"))
    blank = (
        keyed.where(F.col(tokens) == 0)
        .join(stops, "query_id", "left")
        .where(F.col("_stop").isNull() | (F.struct(*keys) < F.col("_stop")))
        .drop("_stop")
    )
    return kept.unionByName(blank).drop(*keys)


def relative_score(selected: DataFrame, score: str) -> DataFrame:
    """Share of the best score among a query's selected rows (k rows per query), and the same in percent."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    share = F.when(best == 0, F.lit(0.0)).otherwise(F.col(score) / best)
    return selected.withColumn("_share", F.coalesce(share, F.lit(0.0))).withColumns({
        "similarity_score": F.round("_share", 4),
        "match_percentage": F.round(F.col("_share") * 100, 2),
    }).drop("_share")


def page_bounds(page, size) -> tuple[int, int]:
    """Page number and size after defaults and limits."""
    page = page if isinstance(page, int) and page > 0 else 1
    size = size if isinstance(size, int) and size > 0 else fv.DEFAULT_PAGE_SIZE
    return page, min(size, fv.MAX_PAGE_SIZE)


def paginate(df: DataFrame, order: list[Column | str], page=1, size=fv.DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page in a unique order."""
    page, size = page_bounds(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
