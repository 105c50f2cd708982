"""Context building: compression decision, forum removal, token budget, assembly and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.operators.ranking import token_budget
from ragspark.session import cut_lineage

COMPRESSED, PASSED = "compressed", "passthrough"


def with_signals(chunks: DataFrame) -> DataFrame:
    """Adds the row-level signals the decision and the compression share, so each text is inspected once."""
    return chunks.withColumns({
        "is_forum": tx.is_forum_source(F.col("source")),
        "is_noise": tx.has_forum_noise(F.col("chunk_text")),
        "is_code": tx.has_code_mixture(F.col("chunk_text")),
    })


def compression_decision(chunks: DataFrame) -> DataFrame:
    """One row per query: the sums behind the decision and the mode. Partial sums before the shuffle."""
    flags = chunks if "is_forum" in chunks.columns else with_signals(chunks)
    totals = flags.groupBy("query_id").agg(
        F.sum("token_estimate").alias("total_tokens"),
        F.count("*").alias("rows"),
        F.round(F.avg(F.coalesce("rerank_score", F.lit(0.0))), 6).alias("mean_rerank"),
        F.bool_or("is_forum").alias("any_forum"),
        F.bool_or("is_noise").alias("any_noise"),
        F.bool_or("is_code").alias("any_code"),
    )
    compress = (
        (F.col("total_tokens") > fv.CONTEXT_TOKENS)
        | (F.col("rows") > fv.CONTEXT_ROWS)
        | (F.col("mean_rerank") < fv.MIN_RERANK_SCORE)
        | F.col("any_forum") | F.col("any_noise") | F.col("any_code")
    )
    return totals.withColumn("mode", F.when(compress, COMPRESSED).otherwise(PASSED))


def drop_low_rerank(non_forum: DataFrame) -> DataFrame:
    """Rows with enough rerank score; all rows of a query that has none. Good rows are not shuffled."""
    good = non_forum.where(F.col("rerank_score") >= fv.MIN_RERANK_SCORE)
    weak = non_forum.where(F.coalesce(F.col("rerank_score"), F.lit(0.0)) < fv.MIN_RERANK_SCORE)
    return good.unionByName(weak.join(good.select("query_id").distinct(), "query_id", "left_anti"))


def compress(chunks: DataFrame) -> DataFrame:
    """Forum rows out, weak rows out, best first, cut to the token budget."""
    flags = chunks if "is_forum" in chunks.columns else with_signals(chunks)
    cleaned = drop_low_rerank(flags.where(~F.col("is_forum") & ~F.col("is_noise")))
    order = [-F.coalesce(F.col("rerank_score"), F.lit(0.0)), F.col("rank")]
    return token_budget(cleaned, order)


def final_context(chunks: DataFrame) -> DataFrame:
    """Compressed or passed-through blocks ``(query_id, mode, block, text, source, confidence)``.

    ``chunks`` are a query's reranked rows, unique by ``rank``. Each text is inspected once; what the decisions need
    is kept in narrow rows in the shared checkpoint folder, and the texts join only the rows that were picked.
    """
    slim = cut_lineage(with_signals(chunks).select(
        "query_id", "rank", "token_estimate", "rerank_score", "is_forum", "is_noise", "is_code"))
    modes = compression_decision(slim).select("query_id", "mode")
    routed = slim.join(modes, "query_id")
    picked = compress(routed.where(F.col("mode") == COMPRESSED)).unionByName(routed.where(F.col("mode") == PASSED))
    block = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    numbered = picked.select("query_id", "rank", "mode", block.alias("block"))
    return chunks.join(numbered, ["query_id", "rank"]).select(
        "query_id",
        "mode",
        "block",
        F.col("chunk_text").alias("text"),
        "source",
        sc.confidence(F.col("rerank_score"), F.col("similarity")).alias("confidence"),
    )


def joined(df: DataFrame, by: list[str], order: str, text, out: str, separator: str) -> DataFrame:
    """Texts of a key in order, as one string. Meant for keys with a bounded number of rows, such as top-k hits."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(out))


def assemble_context(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Documents of a query in rank order, a blank line between them, empty ones left out."""
    filled = hits.where(F.col("document").isNotNull() & (F.col("document") != ""))
    return joined(filled, [by], "rank", F.col("document"), "context", "\n\n")


def build_prompt(queries: DataFrame, contexts: DataFrame, template: str) -> DataFrame:
    """``(query_id, prompt)``: the template with the query and its context, empty context included."""
    head, middle, tail = template.replace("{query}", "\0").replace("{context}", "\0").split("\0")
    both = queries.select("query_id", "query").join(contexts, "query_id", "left")
    text = F.coalesce("context", F.lit(""))
    return both.select(
        "query_id", F.concat(F.lit(head), F.col("query"), F.lit(middle), text, F.lit(tail)).alias("prompt"))


def web_prompt(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Prompt with numbered sources from final context blocks."""
    line = F.concat(F.lit("Source "), F.col("block").cast("string"), F.lit(": "), F.col("text"))
    return build_prompt(queries, joined(blocks, ["query_id"], "block", line, "context", "\n\n"), fv.WEB_PROMPT)


def passage_prompt(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return build_prompt(queries, assemble_context(hits), fv.PASSAGE_PROMPT)


def assemble_pages(pages: DataFrame, by: str, order: str, text: str, sheet: int = 256) -> DataFrame:
    """Page texts in page order, a newline after each, one string per document.

    Pages are joined in two steps, first in sheets of 256 and then sheet by sheet, so the second shuffle moves a few
    long strings and no task sorts the single pages of a long document.
    """
    sheets = pages.withColumn("_sheet", F.floor(F.col(order) / sheet)).where(F.col(text).isNotNull())
    with_end = F.concat(F.col(text), F.lit("\n"))
    partial = joined(sheets, [by, "_sheet"], order, with_end, "_part", "")
    return joined(partial, [by], "_sheet", F.col("_part"), "text", "")
