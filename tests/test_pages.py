"""Stored page order, versioned tables and the written merge."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ragspark.operators import catalog, pages
from ragspark.session import shared_folder
from ragspark.sources import versions


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "c", None]) if i % 3 else "b", f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, title string, note string").repartition(6)
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0])), df


def ids(df):
    return [r.id for r in df.collect()]


def test_pages_in_order(table):
    rows, df = table
    index = pages.page_index(df, ["title", "id"], part_rows=130)
    want = [r[0] for r in rows]
    assert index.total == 3000 and index.parts.count() > 10
    for number, size in [(1, 20), (75, 40), (3, 1000), (4, 1000), (1, 5000)]:
        assert ids(pages.page(index, number, size)) == want[(number - 1) * size:number * size]
    assert pages.page(index, 1, 20).columns == ["id", "title", "note"]


def test_a_deep_page_reads_one_part(table):
    rows, df = table
    index = pages.page_index(df, ["title", "id"], part_rows=130)
    deep = pages.page(index, 2900, 1)
    assert ids(deep) == [rows[2899][0]]
    plan = deep._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(set(scans)) == 1 and re.search(r"_part#\d+ = \d+", scans[0])


def test_small_parts_of_a_large_table_stay_few(spark, monkeypatch):
    monkeypatch.setattr(pages, "MOST_PARTS", 12)
    df = spark.range(5000).select(F.col("id"), F.format_string("t%05d", F.col("id")).alias("title"))
    index = pages.page_index(df, ["title", "id"], part_rows=5)
    assert index.total == 5000 and index.parts.count() <= 12
    assert ids(pages.page(index, 31, 100)) == list(range(3000, 3100))
    assert ids(pages.after(index, ("t04890", 4890), 200)) == list(range(4891, 5000))
    monkeypatch.setattr(pages, "PART_ROWS", 100)
    assert 12 < pages.page_index(df, ["title", "id"], part_rows=5).parts.count() <= 50


def test_rows_behind_a_key(table):
    rows, df = table
    index = pages.page_index(df, ["title", "id"], part_rows=130)
    assert ids(pages.after(index, None, 25)) == [r[0] for r in rows[:25]]
    for at in (0, 1, 99, 1499, 2980, 2999):
        key = rows[at][1], rows[at][0]
        assert ids(pages.after(index, key, 150)) == [r[0] for r in rows[at + 1:at + 151]]
    between = rows[500][1], rows[500][0]
    without = pages.page_index(df.where(F.col("id") != rows[500][0]), ["title", "id"], part_rows=90)
    assert ids(pages.after(without, between, 5)) == [r[0] for r in rows[501:506]]


def test_numbers_without_gaps(table):
    rows, df = table
    got = pages.numbered(df.drop("note").withColumnRenamed("id", "key"), ["title", "key"], 10).collect()
    assert sorted((r.id, r.key) for r in got) == [(10 + i, r[0]) for i, r in enumerate(rows)]


def test_empty_pages(table):
    _, df = table
    index = pages.page_index(df.where("false"), ["title", "id"])
    assert index.total == 0 and ids(pages.page(index, 1, 10)) == [] and ids(pages.after(index, None, 10)) == []


def test_a_table_is_replaced_as_a_whole(spark):
    path = shared_folder(spark, "versions")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, path)
    versions.replace_table(spark.range(5), path, 5)
    held = versions.read_current(spark, path)
    with pytest.raises(ValueError):
        versions.replace_table(spark.range(7), path, 8)
    assert versions.read_current(spark, path).count() == 5
    spark.range(9).write.parquet(f"{path}/v-unfinished")
    assert versions.read_current(spark, path).count() == 5
    versions.replace_table(spark.range(3), path)
    assert versions.read_current(spark, path).count() == 3 and held.count() == 5


SCHEMA = ("id int, uid string, title string, author string, isbn string, topic string, description string, cover_image_url string, "
          "published_year int")


def book(i, uid, isbn, title="t"):
    return i, uid, title, "a", isbn, None, None, None, 2000


def test_merge_with_shared_isbns(spark):
    held = spark.createDataFrame([book(1, "lib-1", "i1"), book(2, "lib-2", "i1"), book(3, "lib-3", "i3"), book(4, "lib-4", ""),
                                  book(5, "book-5", "i5"), book(6, "lib-6", None)], SCHEMA)
    canonical = spark.createDataFrame([book(0, "new-1", "i1"), book(0, "lib-3", "i3"), book(0, "new-3", "i3"), book(0, "new-4", ""),
                                       book(0, "b-five", "i5"), book(0, "a-five", "i5"), book(0, "new-6", None)], SCHEMA)
    plan = catalog.merge_plan(held, canonical)
    got = sorted((r.uid, r.id, r.action) for r in plan.collect())
    assert got == sorted([("new-1", 2, "update"), ("lib-1", 1, "keep"), ("lib-3", 3, "unchanged"), ("new-3", None, "insert"),
                          ("new-4", None, "insert"), ("lib-4", 4, "keep"), ("a-five", 5, "update"), ("b-five", None, "insert"),
                          ("new-6", None, "insert"), ("lib-6", 6, "keep")], key=lambda x: (x[0], x[1] or 0, x[2]))
    path = shared_folder(spark, "catalog")
    written = {r.uid: r.id for r in catalog.write_merged(plan, path).collect()}
    assert written == {"new-1": 2, "lib-1": 1, "lib-3": 3, "lib-4": 4, "a-five": 5, "lib-6": 6, "b-five": 7, "new-3": 8,
                       "new-4": 9, "new-6": 10}
    again = catalog.merge_plan(versions.read_current(spark, path), canonical)
    assert {r.action for r in again.collect()} <= {"unchanged", "keep"}
