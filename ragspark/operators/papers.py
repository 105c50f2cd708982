"""Paper records: two source schemas, cleaning, access filter, hybrid search and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.operators import bm25
from ragspark.operators.dedupe import first_seen
from ragspark.operators.ranking import relative_score, top_k
from ragspark.operators.vectors import nearest
from ragspark.session import cut_lineage

PAPER = ["title", "doi", "year", "abstract", "citations", "publisher", "is_oa", "pdf"]


def from_graph_source(raw: DataFrame, *keep: str) -> DataFrame:
    """``paperId, title, year, abstract, venue, citationCount, openAccessPdf{url}`` as papers."""
    return raw.select(
        *keep,
        "title",
        F.col("paperId").alias("doi"),
        "year",
        "abstract",
        F.coalesce("citationCount", F.lit(0)).alias("citations"),
        F.coalesce("venue", F.lit("")).alias("publisher"),
        F.col("openAccessPdf").isNotNull().alias("is_oa"),
        F.col("openAccessPdf.url").alias("pdf"),
    )


def from_works_source(raw: DataFrame, *keep: str) -> DataFrame:
    """``id, title, publication_year, cited_by_count, abstract_inverted_index, host_venue, open_access`` as papers."""
    return raw.select(
        *keep,
        "title",
        F.col("id").alias("doi"),
        F.col("publication_year").alias("year"),
        F.coalesce(tx.rebuild_abstract(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
        F.coalesce("host_venue.publisher", F.lit("")).alias("publisher"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.col("open_access.oa_url").alias("pdf"),
    )


def with_source_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first source; for queries it has none for, rows of the second."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def clean_metadata(papers: DataFrame) -> DataFrame:
    """Casts with defaults: numbers 0, texts empty, flag false."""
    empty = F.lit("")
    return papers.withColumns({
        "title": F.coalesce("title", empty),
        "doi": F.coalesce("doi", empty),
        "year": F.coalesce(F.col("year").try_cast("int"), F.lit(0)),
        "abstract": F.coalesce("abstract", empty),
        "citations": F.coalesce(F.col("citations").try_cast("int"), F.lit(0)),
        "is_oa": F.coalesce(F.col("is_oa").try_cast("boolean"), F.lit(False)),
        "pdf": F.coalesce("pdf", empty),
        "publisher": F.coalesce("publisher", empty),
    })


def paper_text(papers: DataFrame) -> DataFrame:
    return papers.withColumn(
        "text", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))


def paper_key():
    """The paper's identifier; without one, a digest of its title (a row position would clash between batches)."""
    return F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.sha2(F.coalesce("title", F.lit("")), 256))


def access_filter(papers: DataFrame, kind: str = "all") -> DataFrame:
    """``open_access``, ``subscription`` or ``all``.

    Subscription keeps papers of known publishers; a query without any keeps its papers that are not open access.
    """
    if kind not in ("all", "open_access", "subscription"):
        raise ValueError("filter_type must be one of: all, open_access, subscription")
    if kind == "all":
        return papers
    if kind == "open_access":
        return papers.where(F.col("is_oa"))
    papers = cut_lineage(papers)  # read three times below, and usually the result of a search
    known = papers.where(F.lower(F.coalesce("publisher", F.lit(""))).rlike("|".join(fv.SUBSCRIPTION_PUBLISHERS)))
    served = known.select("query_id").distinct()
    closed = papers.where(~F.coalesce("is_oa", F.lit(False))).join(served, "query_id", "left_anti")
    return known.unionByName(closed)


def dedupe_titles(papers: DataFrame) -> DataFrame:
    """First paper per query and title in list order; papers without a title count as one."""
    return first_seen(papers, ["query_id", "title"], [F.asc("pos")])


def merge_hits(vector_hits: DataFrame, text_hits: DataFrame, papers: DataFrame, k: int = fv.PAPER_TOP_K) -> DataFrame:
    """Vector hits, then BM25 hits; one per title; most cited first; k per query.

    Titles and citations decide; the other columns join the papers that stay.
    """
    both = vector_hits.select("query_id", "paper_id", F.lit(0).alias("branch"), F.col("rank").alias("place")) \
        .unionByName(text_hits.select("query_id", "paper_id", F.lit(1).alias("branch"), F.col("rank").alias("place")))
    slim = both.join(papers.select("paper_id", "title", "citations"), "paper_id")
    once = first_seen(slim, ["query_id", "title"], [F.asc("branch"), F.asc("place")])
    best = top_k(once, ["query_id"], [F.desc("citations"), F.asc("branch"), F.asc("place")], k)
    return best.join(papers.drop("title", "citations"), "paper_id")


def hybrid_search(queries: DataFrame, papers: DataFrame, index: bm25.Bm25Index, k: int = fv.PAPER_TOP_K) -> DataFrame:
    """Squared-distance neighbours and BM25 hits of each query, merged.

    ``queries``: query_id, query, embedding. ``papers``: paper_id, text, embedding and the paper columns.
    """
    near = nearest(queries, papers, k, corpus_key="paper_id", metric="l2")
    found = bm25.search_filled(queries, papers, index, k, key="paper_id")
    return merge_hits(near, found, papers.select("paper_id", *PAPER), k)


def plain_ranking(papers: DataFrame, k: int = fv.PAPER_TOP_K) -> DataFrame:
    """Without vectors: source order after removing repeated titles."""
    return top_k(dedupe_titles(papers), ["query_id"], [F.asc("pos")], k)


def present(papers: DataFrame, k: int) -> DataFrame:
    """Cut to k, renumber, and add summary, source link and score relative to the most cited paper shown."""
    cut = top_k(papers.drop("rank"), ["query_id"], [F.desc("citations"), F.asc("branch"), F.asc("place")], k) \
        if "branch" in papers.columns else top_k(papers.drop("rank"), ["query_id"], [F.asc("pos")], k)
    scored = relative_score(cut.withColumn("citations", F.coalesce("citations", F.lit(0))), "citations")
    abstract = tx.strip(F.coalesce("abstract", F.lit("")))
    return scored.select(
        "query_id",
        "rank",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        "year",
        abstract.alias("abstract"),
        tx.summary(abstract).alias("summary"),
        "citations",
        F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce("is_oa", F.lit(False)).alias("is_oa"),
        "pdf",
        sc.source_url(F.col("pdf"), F.col("doi"), F.col("title")).alias("source_url"),
        "similarity_score",
        "match_percentage",
    )
