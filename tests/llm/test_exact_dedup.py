"""Grace hash deduplication against a dictionary of whole texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragspark.llm import exact_dedup

LONG = "a very long text " * 40_000
ROWS = ([(i, f"text {i % 7}") for i in range(40)] + [(i, None if i % 2 else "") for i in range(40, 50)]
        + [(50, LONG), (51, LONG + "!"), (52, LONG), (None, LONG), (None, "only null ids"), (None, "only null ids"),
           (60, "twice"), (60, "twice"), (61, "Twice"), (62, "twice "), (63, "é"), (64, "é"), (65, "\x00"), (66, " ")])


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    return plain.select("*", F.lit("x").alias("key"), F.lit(1).alias("bucket"), F.lit(2).alias("ids"), F.lit(0).alias("content"))


def check(got, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    of = defaultdict(list)
    for r in got:
        of[r.text_sha256].append(r)
    assert set(of) == set(groups)
    for digest, members in of.items():
        ids = [i for i in groups[digest] if i is not None]
        top = max(ids) if ids else None
        assert sorted(map(str, (r.doc_id for r in members))) == sorted(map(str, groups[digest]))
        assert {(r.keep_id, r.group_size) for r in members} == {(top, len(members))}
        assert [r.doc_id for r in members if r.kept] == [top]


def test_groups(docs):
    check(exact_dedup.exact_duplicates(docs).collect(), ROWS)


def test_equal_hashes_of_different_texts(docs):
    check(exact_dedup.exact_duplicates(docs, key_of=lambda content: 5).collect(), ROWS)
    check(exact_dedup.exact_duplicates(docs, key_of=lambda content: len(content) % 3).collect(), ROWS)


def test_buckets_that_do_not_fit_are_dealt_again(docs, monkeypatch):
    spills, store = [], exact_dedup.stored

    def watched(df):
        spills.append(df.columns)
        return store(df)

    monkeypatch.setattr(exact_dedup, "stored", watched)
    short = [r for r in ROWS if len(r[1] or "") < 100]
    check(exact_dedup.exact_duplicates(docs.where("coalesce(length(text), 0) < 100"), target=250, limit=150, held=300).collect(),
          short)
    assert sum("content" in columns for columns in spills) >= 3


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], "name string, body string")
    got = {(r.name, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df, "name", "body").collect()}
    assert got == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)}


def test_empty(docs):
    got = exact_dedup.exact_duplicates(docs.where("false"))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_content_table_probes_past_other_contents():
    table = exact_dedup.ContentTable()
    contents = [str(i).encode() for i in range(5000)]
    assert [table.entry(7, c) for c in contents[:300]] == [*range(300)]
    assert [table.entry(i << 20, c) for i, c in enumerate(contents)][300:] == [*range(600, 5300)]
    assert [table.entry(7, c) for c in contents[:300]] == [*range(300)]
