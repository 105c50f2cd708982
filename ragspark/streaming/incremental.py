"""Incremental forms of index maintenance and of the active book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ragspark.operators.embedding import Embedder
from ragspark.sources.tables import insert_if_absent


def maintain_index(
    rows: DataFrame, embedder: Embedder, text: str, key: str, path: str, checkpoint: str
) -> DataStreamWriter:
    """Embeds arriving catalog rows once and appends those the index lacks.

    A micro-batch that is replayed after a failure finds its rows in the index and adds nothing.
    """
    def write(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, path, key, lambda fresh: embedder(fresh, text, "embedding"))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_active_book(scans: DataFrame, by: str, value: str, ts: str, tie: str) -> DataFrame:
    """Most recent value per key, updated with every scan. State is one row per key, which is also the result."""
    timed = scans.withColumn("_at", F.col(ts).cast("timestamp"))
    return timed.groupBy(by).agg(F.max_by(value, F.struct("_at", tie)).alias("active_book"))


def keep_latest(live: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stores the rows that changed in each micro-batch as a partition of their own.

    A batch that is replayed after a failure overwrites its own partition, so nothing is stored twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return live.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The present row of every key of a table that ``keep_latest`` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (by, "batch")]
    return rows.groupBy(by).agg(F.max_by(F.struct(*values), "batch").alias("_row")).select(by, "_row.*")
