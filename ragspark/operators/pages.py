"""Deep pages of a large table: a stored order, so a page reads the parts it lies in and nothing before them.

The rows are sorted once by a unique order, over as many range partitions as their number asks for, and written by
partition with each row's place in it. One narrow row for each partition holds its first place and its boundary keys.
A page asks that table which partitions it needs; a scan with a filter on the partition column reads them alone. ``after``
continues behind a key instead of a number, so rows that come or go before it do not shift the page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.session import cut_lineage, shared_folder

PART_ROWS = 1_000_000
#: Folders a table may have however small the wanted parts are; beyond, parts grow up to ``PART_ROWS`` before their number does.
MOST_PARTS = 256


@dataclass(frozen=True)
class PageIndex:
    """``rows`` has the table's columns, ``_part`` and ``_at``; ``parts`` is ``(_part, _first, _rows, _least, _most)``."""

    rows: DataFrame
    parts: DataFrame
    order: tuple[str, ...]
    total: int


def page_index(df: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> PageIndex:
    """The table in ascending order of columns that name a row; nulls come first.

    Parts have about ``part_rows`` rows, and more where that would make more than ``MOST_PARTS`` of them: a page reads a range
    of its part, but every part costs a task, a folder and a row of the driver's file list.
    """
    rows = df.count()
    wanted = max(1, min(-(-rows // part_rows), max(MOST_PARTS, -(-rows // PART_ROWS))))
    placed = df.repartitionByRange(wanted, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    path = shared_folder(df.sparkSession, "pages")
    placed.write.partitionBy("_part").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    key = F.struct(*order)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.min(key).alias("_least"), F.max(key).alias("_most"))
    # one row for each partition, so the ordered sum is small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long"))))
    total = parts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    return PageIndex(rows, parts, tuple(order), total)


def _of_parts(index: PageIndex, numbers: list[int], columns: list[str]) -> DataFrame:
    return index.rows.where(F.col("_part").isin(numbers) if numbers else F.lit(False)).select(*columns, "_part", "_at")


def page(index: PageIndex, number: int, size: int) -> DataFrame:
    """Rows of page ``number``, counted from 1, in order."""
    columns = [c for c in index.rows.columns if c not in ("_part", "_at")]
    start = (number - 1) * size
    needed = index.parts.where((F.col("_first") < start + size) & (F.col("_first") + F.col("_rows") > start))
    found = {r["_part"]: r["_first"] for r in needed.select("_part", "_first").collect()}
    shown = None
    for part, first in found.items():
        some = _of_parts(index, [part], columns).where(F.col("_at").between(start - first, start - first + size - 1))
        shown = some if shown is None else shown.unionByName(some)
    shown = _of_parts(index, [], columns) if shown is None else shown
    return shown.orderBy("_part", "_at").drop("_part", "_at")


def after(index: PageIndex, key: tuple | None, size: int) -> DataFrame:
    """The first ``size`` rows behind a row's key, in order; from the start without one."""
    columns = [c for c in index.rows.columns if c not in ("_part", "_at")]
    kinds = [index.rows.schema[c].dataType for c in index.order]
    behind = F.lit(True) if key is None else F.struct(*index.order) > F.struct(
        *[F.lit(v).cast(k).alias(c) for v, k, c in zip(key, kinds, index.order)])
    left = F.lit(True) if key is None else F.col("_most") > F.struct(
        *[F.lit(v).cast(k).alias(c) for v, k, c in zip(key, kinds, index.order)])
    # the boundary's part may give a single row, so the next ones follow until they hold enough; empty ranges have no row
    numbers, held = [], 0
    for row in index.parts.where(left).orderBy("_part").limit(size + 1).select("_part", "_rows").collect():
        numbers.append(row["_part"])
        held += row["_rows"] if len(numbers) > 1 or key is None else 0
        if held >= size:
            break
    return _of_parts(index, numbers, columns).where(behind).orderBy("_part", "_at").limit(size).drop("_part", "_at")


def numbered(df: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """``df`` with numbers from ``start`` on in the given order, without gaps and without one task for all rows."""
    index = page_index(df, order)
    return index.rows.join(index.parts.select("_part", "_first"), "_part").select(
        *df.columns, (F.col("_first") + F.col("_at") + start).alias(name))
