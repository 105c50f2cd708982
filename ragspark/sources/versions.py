"""Tables that are replaced as a whole: every write is a directory of its own, and a small file names the current one.

The pointer is written beside and renamed over the old one, so a reader finds the whole old or the whole new table, and a
job that dies leaves the old one current. Versions that are no longer named can be dropped when no reader is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
NOTE = "_note"


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _context(spark: SparkSession, path: str):
    whole = _file_system(spark, path).makeQualified(_hadoop_path(spark, path))
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file's content; nothing if there is no such file."""
    file, files = _hadoop_path(spark, path), _file_system(spark, path)
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small text file."""
    stream = _file_system(spark, path).create(_hadoop_path(spark, path), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> str | None:
    """The directory that the pointer names; nothing before the first write."""
    name = read_text(spark, f"{path}/{POINTER}")
    return None if name is None else f"{path}/{name.strip()}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of {path} has been committed")
    return spark.read.parquet(version)


def replace_table(df: DataFrame, path: str, rows: int | None = None, note: str | None = None) -> str:
    """Write a new version and make it current; if ``rows`` is given, only a table of that many rows is.

    ``note`` is kept inside the version (``note_of``), so it becomes current in the same step as the rows.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    if rows is not None and (found := spark.read.schema(df.schema).parquet(f"{path}/{name}").count()) != rows:
        raise ValueError(f"{found} rows written, {rows} expected; the old version stays current")
    if note is not None:
        write_text(spark, f"{path}/{name}/{NOTE}", note)
    point_to(spark, path, name)
    return f"{path}/{name}"


def note_of(spark: SparkSession, version: str) -> str | None:
    """The note a version was written with."""
    return read_text(spark, f"{version}/{NOTE}")


def point_to(spark: SparkSession, path: str, name: str) -> None:
    """Make a written version the current one."""
    context, beside = _context(spark, path), f"{path}/{POINTER}-{uuid.uuid4().hex}"
    write_text(spark, beside, name)
    overwrite = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    context.rename(_hadoop_path(spark, beside), _hadoop_path(spark, f"{path}/{POINTER}"), options)
