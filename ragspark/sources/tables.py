"""Sinks: stage tables and envelopes, vector collections, and index tables that only ever grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import scalars as sc
from ragspark.operators.dedupe import first_seen
from ragspark.session import cut_lineage

ROWS_PER_FILE = 1_000_000
ENVELOPE_ROWS = 1_000


def envelope(
    queries: DataFrame, rows: DataFrame, stage: str, fields: list[str], order: str, now: Column,
    list_name: str = "rows", size: int = ENVELOPE_ROWS,
) -> DataFrame:
    """One record per query: query, stage, UTC stamp, number of rows and the rows in order.

    A query with more than ``size`` rows gets several numbered records, so no task gathers more than ``size`` rows of
    a query; ``num_rows`` is the query's total in each. Queries without rows get one record with an empty list.
    """
    part = F.floor(F.col(order) / size).alias("part")
    item = F.struct(F.col(order), *[c for c in fields if c != order])
    packed = rows.groupBy("query_id", part).agg(F.array_sort(F.collect_list(item)).alias(list_name))
    counts = rows.groupBy("query_id").agg(F.count("*").alias("num_rows"))
    full = queries.select("query_id", "query").join(counts, "query_id", "left").join(packed, "query_id", "left")
    return full.select(
        "query_id",
        "query",
        F.lit(stage).alias("stage"),
        sc.stage_stamp(now).alias("timestamp_utc"),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("num_rows", F.lit(0)).alias("num_rows"),
        F.coalesce(list_name, F.array().cast(packed.schema[list_name].dataType)).alias(list_name),
    )


def write_stage(df: DataFrame, folder: str, stage: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/stage={stage}")


def retrieval_records(queries: DataFrame, hits: DataFrame, summary: DataFrame, now: Column) -> DataFrame:
    """One nested record per answered query: its hits (top-k, so few) and its summary."""
    hit = F.struct("rank", "chunk_id", F.round("similarity", 4).alias("similarity_score"), "document")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    facts = F.struct("total_results", "top_similarity_score", "threshold_used", "model_used").alias("summary")
    return queries.join(lists, "query_id").join(summary, "query_id").select(
        "query_id", now.cast("string").alias("timestamp"), "query", "book", "results", facts)


def write_collections(vectors: DataFrame, path: str, by: str = "book_uid", key: str = "chunk_id") -> None:
    """Replaces the collections present in ``vectors`` and leaves all others alone.

    Rows are spread by collection and a hash of their key, as many files as the collection needs.
    """
    sizes = vectors.groupBy(by).agg(F.ceil(F.count("*") / ROWS_PER_FILE).cast("int").alias("_files"))
    spread = vectors.join(sizes, by).withColumn("_file", F.pmod(F.xxhash64(key), F.col("_files")))
    (
        spread.repartition(by, "_file").drop("_files", "_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    )


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def new_rows(batch: DataFrame, index: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the index does not hold yet."""
    return batch if index is None else batch.join(index.select(key), key, "left_anti")


def delivery_status(batch: DataFrame, index: DataFrame | None, key: str, vector: str = "embedding") -> DataFrame:
    """``(key, status, rows)`` of a batch: ``duplicate`` if indexed already, ``failed`` without a usable vector, else
    ``successful``. A key delivered several times counts once; its other deliveries are duplicates."""
    usable = F.coalesce(F.size(vector) > 0, F.lit(False))
    keys = batch.groupBy(key).agg(F.count("*").alias("_n"), F.max(usable).alias("_usable"))
    held = F.lit(False)
    if index is not None:
        keys = keys.join(index.select(key, F.lit(True).alias("_held")), key, "left")
        held = F.coalesce("_held", F.lit(False))
    good = F.when(~held & F.col("_usable"), 1).otherwise(0)
    bad = F.when(~held & ~F.col("_usable"), F.col("_n")).otherwise(0)
    counts = {"successful": good, "failed": bad, "duplicate": F.col("_n") - good - bad}
    listed = F.array(*[F.struct(F.lit(s).alias("status"), n.cast("long").alias("rows")) for s, n in counts.items()])
    return keys.select(key, F.explode(listed).alias("_s")).select(key, "_s.*").where(F.col("rows") > 0)


def insert_if_absent(batch: DataFrame, path: str, key: str,
                     prepare: Callable[[DataFrame], DataFrame] = lambda fresh: fresh) -> DataFrame:
    """Appends the rows of a batch that the index lacks, one per key, and returns them.

    ``prepare`` (such as an embedder) sees only rows that are new. Running it again with the same batch changes nothing.
    """
    spark = batch.sparkSession
    once = first_seen(batch, [key], [F.xxhash64(*batch.columns)])
    fresh = cut_lineage(prepare(new_rows(once, stored(spark, path), key)))
    fresh.write.mode("append").parquet(path)
    return fresh


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.sum("rows").alias("rows"))


def mark_processed(catalog: DataFrame, status: DataFrame, key: str = "book_id") -> DataFrame:
    """Catalog with ``processed`` set for delivered keys, both new ones and duplicates."""
    done = status.where(F.col("status") != "failed").select(key).distinct().withColumn("_done", F.lit(True))
    return catalog.join(done, key, "left").withColumn(
        "processed", F.coalesce("_done", F.col("processed"), F.lit(False))).drop("_done")
