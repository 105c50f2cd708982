"""The shared test tables seen as the entities of the flows. Every view keeps all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.sources.files import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages", "embeddings", "part") else rows


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark passage as a query."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def web_results(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a search result of one query.

    Paragraph breaks, bullets, pronouns, forum phrases and code lines are added by document number, because the raw
    texts have none.
    """
    asked = queries(spark, folder)
    n = asked.count()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    host = F.when(F.col("source") == "src11", "stackoverflow.com").otherwise(F.concat("source", F.lit(".example.com")))
    i, content = F.col("doc_id"), F.col("text")
    content = F.when(i % 3 == 0, F.replace(content, F.lit("\n"), F.lit("\n\n"))).otherwise(content)
    content = F.when(i % 5 == 0, F.concat(F.lit("- "), content)).otherwise(content)
    content = F.when(i % 7 == 0, F.concat(content, F.lit(" you we your our"))).otherwise(content)
    content = F.when(i % 11 == 0, F.concat(content, F.lit(" What is the best? Pros and cons. Posted by"))).otherwise(
        content)
    content = F.when(i % 13 == 0, F.concat(content, F.lit("\ndef f():\n{\n}\n// x"))).otherwise(content)
    rows = docs.select(
        "doc_id",
        (i % n).alias("query_id"),
        F.floor(i / n).cast("int").alias("pos"),
        F.concat(F.lit("https://"), host, F.lit("/"), i.cast("string")).alias("url"),
        ((i * 37 % 100) / 100.0).alias("score"),
        content.alias("content"),
    )
    return spread(rows).join(asked, "query_id")


def context_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every web result as one reranked chunk."""
    i = F.col("doc_id")
    return web_results(spark, folder).select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("url").alias("source"),
        F.col("content").alias("chunk_text"),
        tx.token_estimate(F.col("content")).alias("token_estimate"),
        (i * 7919 % 1000 / 100.0).alias("rerank_score"),
        F.col("score").alias("similarity"),
    )


def passage_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector read backwards as a query to the book of its label."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("book-"), F.col("label").cast("string")).alias("book_uid"),
        F.reverse("embedding").alias("embedding"),
    )


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a chunk of the book of its label."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("book-"), F.col("label").cast("string")).alias("book_uid"),
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("passage "), F.col("vec_id").cast("string")).alias("document"),
        "embedding",
    )


def books(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a book of the library catalog."""
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.cast("int").alias("id"),
        F.concat(F.when(k % 4 == 0, "lib-").otherwise("book-"), k.cast("string")).alias("uid"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.when(k % 10 != 0, F.concat(F.lit("isbn-"), k.cast("string"))).alias("isbn"),
        F.col("p_type").alias("topic"),
        F.concat("p_name", F.lit(", "), "p_type").alias("description"),
        F.lit(None).cast("string").alias("cover_image_url"),
        (F.col("p_size") + 1990).alias("published_year"),
    )


def recommender_books(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a book of the recommender catalog."""
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("book_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_type", "p_name", F.lit("in size"), size.cast("string")).alias("summary"),
        F.when(size % 3 == 0, True).when(size % 3 == 1, False).alias("processed"),
    )


def book_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier's and nation's name with a wish list as a keyword question."""
    from_nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        F.concat_ws(" ", F.lit("Brand#1"), F.element_at(F.split("n_name", "_"), 2), F.lit("red  bolt nat")).alias("query"))
    from_supplier = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 1000).alias("query_id"),
        F.concat_ws(" ", F.lit("small WIDGET"), F.col("s_nationkey").cast("string"), F.lit("economy")).alias("query"))
    return from_nation.unionByName(from_supplier)


PUBLISHERS = ["IEEE", "Elsevier", "Springer Nature", "MIT Press", ""]


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a paper; its first line is the title."""
    i = F.col("doc_id")
    return table(spark, folder, "documents").select(
        i.alias("paper_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(i % 4 == 0, F.concat(F.lit("10.1/"), i.cast("string"), F.lit(" x")))
        .when(i % 4 == 1, F.concat(F.lit("https://id.example.org/"), i.cast("string")))
        .when(i % 4 == 2, F.concat(F.lit("S"), i.cast("string"))).alias("doi"),
        (i % 40 + 1980).cast("int").alias("year"),
        F.col("text").alias("abstract"),
        (i * 7919 % 500).cast("int").alias("citations"),
        F.get(F.array(*[F.lit(p) for p in PUBLISHERS]), (i % 5).cast("int")).alias("publisher"),
        (i % 3 == 0).alias("is_oa"),
        F.when(i % 6 == 0, F.concat(F.lit("https://pdf.example.org/"), i.cast("string"))).alias("pdf"),
    )


def candidate_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Every paper as a candidate of one query."""
    n = table(spark, folder, "benchmark").count()
    return papers(spark, folder).select(
        (F.col("paper_id") % n).alias("query_id"), F.floor(F.col("paper_id") / n).cast("int").alias("pos"), "*")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a chunk of the document's source."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("source").alias("book_uid"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")
    ).select(
        "book_uid",
        F.when(F.col("line") % 50 != 49, F.col("doc_id") * 100000 + F.col("line")).alias("chunk_id"),
        "text",
    )
