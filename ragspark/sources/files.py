"""Readers of the file formats that enter the flows, with declared schemas, and of catalog tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions.text import strip

#: A scan is dealt out anew if a partition holds so many times its share of the rows, into so many parts for each core or partition.
LUMP, PARTS_PER_CORE = 1.5, 4
CATALOG = (
    "id INT, uid STRING, title STRING, author STRING, isbn STRING, topic STRING, description STRING, "
    "cover_image_url STRING, published_year INT, created_at TIMESTAMP, updated_at TIMESTAMP")
RECOMMENDER_CATALOG = (
    "book_id STRING, title STRING, author STRING, category STRING, year INT, summary STRING, processed BOOLEAN")
SEARCH_PAYLOAD = (
    "query STRING, timestamp_utc STRING, tavily_response STRUCT<query: STRING, results: ARRAY<STRUCT<"
    "url: STRING, title: STRING, content: STRING, score: STRING, raw_content: STRING>>>")
CHUNK_FILE = (
    "total_chunks INT, chunk_size INT, chunk_overlap INT, chunks ARRAY<STRUCT<chunk_id: INT, text: STRING>>")
QUERY_FILE = (
    "query_id STRING, timestamp STRING, query STRING, book STRING, results ARRAY<STRUCT<rank: INT, chunk_id: STRING, "
    "similarity_score: DOUBLE, document: STRING>>, _corrupt STRING")


def catalog_table(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def catalog_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, parts: int, **options: str):
    """Catalog of a relational database, read in ranges of its id; filters on plain columns are pushed to it."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="id", lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(parts), **options).load()


def spread(df: DataFrame) -> DataFrame:
    """Gives every core a part of a scan that has fewer partitions than the cluster has cores, such as one small
    file, or whose rows lie in a few of its partitions only: a file is cut by bytes, but all rows of a row group are read by one
    task. A scan of many row groups is left as it is, so it pays no shuffle.

    The condition that is always true hangs on a seeded random number, which keeps Spark from moving costly text
    filters back below the shuffle, onto the few scan tasks.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df._jdf.rdd().getNumPartitions()
    if parts < cores:
        return df.repartition(cores).where(F.rand(0) >= 0)
    # no column is read for this; the row numbers come from the footers, and one row for each partition to the driver
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    if rows and max(rows) > LUMP * sum(rows) / parts and max(rows) * cores > LUMP * sum(rows):
        # dealt by a number, not in turn, as Spark would sort the whole texts of a scan task for that
        return df.repartition(PARTS_PER_CORE * max(cores, parts), F.rand(0)).where(F.rand(0) >= 0)
    return df


def file_name():
    return F.col("_metadata.file_name")


def book_number(name) -> "F.Column":
    """Number in a file name such as ``book-12_chunks.json``; 1 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"book-(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def payload_rows(payloads: DataFrame, query: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Result rows of search payloads ``(query_id, query, tavily_response)``, and the payloads without results."""
    named = payloads.select(
        "query_id",
        F.coalesce(F.nullif(F.col("query"), F.lit("")), F.nullif(F.lit(query), F.lit("")),
                   F.lit(fv.MISSING_QUERY)).alias("query"),
        F.col("tavily_response.results").alias("results"),
    )
    rows = named.where(F.col("results").isNotNull()).select(
        "query_id", "query", F.posexplode("results").alias("pos", "r"))
    flat = rows.select("query_id", "query", "pos", "r.url", "r.title", "r.score", "r.content")
    return flat, named.where(F.col("results").isNull()).select("query_id", F.lit("missing results").alias("reason"))


def search_payloads(spark: SparkSession, path: str, query: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Result rows of stored search responses, and the files without a result list."""
    raw = spark.read.schema(SEARCH_PAYLOAD).option("multiLine", True).json(path)
    return payload_rows(raw.select(file_name().alias("query_id"), "query", "tavily_response"), query)


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """``(book_uid, chunk_id, text, reason)``: why a chunk is skipped (null: it is not), and its stored text."""
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    reason = (
        F.when(F.col("chunk_id").isNull(), "missing_id")
        .when(text == "", "empty")
        .when(F.length(text) < fv.MIN_CHUNK_CHARS, "too_short")
    )
    return chunks.select(
        "book_uid", "chunk_id", F.substring(text, 1, fv.MAX_CHUNK_CHARS).alias("text"), reason.alias("reason"),
        (F.length(text) > fv.MAX_CHUNK_CHARS).alias("truncated"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of stored chunk files with the reason each skipped one is skipped for."""
    raw = spark.read.schema(CHUNK_FILE).option("multiLine", True).json(path)
    uid = F.concat(F.lit("book-"), book_number(file_name()).cast("string"))
    return valid_chunks(raw.select(uid.alias("book_uid"), F.explode("chunks").alias("c")).select("book_uid", "c.*"))


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``(book_uid, text)``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.concat(F.lit("book-"), book_number(file_name()).cast("string")).alias("book_uid"), F.col("value").alias("text"))


SEGMENT_CHARS = 1 << 20


def text_segments(spark: SparkSession, path: str, chars: int = SEGMENT_CHARS) -> DataFrame:
    """Text files of any size as ordered segments ``(file, book_uid, block, part, text)``.

    Spark cuts a file into byte ranges at line ends (``spark.sql.files.maxPartitionBytes``), so one large file is many tasks.
    ``block`` is where a range starts and ``part`` counts the segments in it; joined by newlines in this order they are
    the file, but for a newline at its end. A segment ends at the first blank line from ``chars`` characters on, or at the
    line end that brings it to twice as many. No text moves between tasks; a task holds one segment. A line must fit one value.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.concat(F.lit("book-"), book_number(file_name()).cast("string")).alias("book_uid"),
        F.col("_metadata.file_block_start").alias("block"), "value")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, part = None, [], 0, 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"file": place[0], "book_uid": place[1], "block": place[2], "part": part, "text": "\n".join(held)}], KIND)
        for batch in batches:
            for file, uid, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, uid, block) != place:
                    if held:
                        yield segment()
                    place, held, size, part = (file, uid, block), [], 0, 0
                held.append(line)
                size += len(line) + 1
                if size >= 2 * chars or size >= chars and not line.strip():
                    yield segment()
                    held, size, part = [], 0, part + 1
        if held:
            yield segment()

    return lines.mapInArrow(gathered, "file string, book_uid string, block long, part long, text string")


KIND = pa.schema([("file", pa.string()), ("book_uid", pa.string()), ("block", pa.int64()), ("part", pa.int64()),
                  ("text", pa.string())])


def check_query_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retrieval records that have all required fields, and the rejected ones with the reason."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("query_id", "query", "results", "book")]),
        lambda c: c.isNotNull(),
    )
    checked = records.withColumn("reason", F.when(F.col("_corrupt").isNotNull(), "invalid json")
                                 .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    good = checked.where(F.col("reason").isNull()).select("query_id", "query", "book", "results")
    return good, checked.where(F.col("reason").isNotNull()).select("file", "reason")


def query_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored retrieval results that have all required fields, and the rejected files."""
    reader = spark.read.schema(QUERY_FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return check_query_records(reader.json(path).select("*", file_name().alias("file")))


def natural_order(collections: DataFrame, name: str = "book_uid") -> DataFrame:
    """Distinct ``book-`` collections with book-2 before book-10."""
    found = collections.where(F.col(name).startswith("book-")).select(name).distinct()
    return found.orderBy(F.regexp_extract(name, r"(\d+)", 1).try_cast("int"), name)
