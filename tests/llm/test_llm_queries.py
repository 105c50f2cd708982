"""The registered queries and the pipeline on the shared tables."""

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragspark.llm import decontamination, jaccard, quality, queries, secret_scan
from ragspark.llm.common import read, stored


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert compare.spark_rows(df) == compare.duck_rows(compare.connect(small), queries.ORACLES[name])
    assert compare.type_differences(df, compare.connect(small), queries.ORACLES[name]) == []


def test_pipeline_stage_by_stage(spark, small):
    docs = read(spark, small, "documents")
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("extra", F.lit("e"))
    for name, stage in corpus_pipeline.STAGES:
        before = {(r.doc_id): r.text for r in docs.collect()}
        after = stored(stage(spark, docs, small))
        if name == "packing":
            assert after.select("doc_id").distinct().count() == len(before)
            continue
        assert after.columns == docs.columns
        left = {r.doc_id: r.text for r in after.collect()}
        if name == "quality classifier":
            model = quality.fit(docs, read(spark, small, "labels"))
            bad = {i for i, t in before.items() if model.score([t or ""])[0] < 0.3}
            assert set(before) - set(left) == bad
        if name == "n-gram Jaccard join":
            gone = {r.doc_id for r in jaccard.near_duplicates(docs).collect() if r.doc_id != r.component_id}
            assert set(before) - set(left) == gone
        if name == "benchmark decontamination":
            gone = {r.doc_id for r in decontamination.leaks(docs, read(spark, small, "benchmark")).collect()}
            assert set(before) - set(left) == gone
            items = [r.text for r in read(spark, small, "benchmark").collect()]
            assert {i for i, t in before.items() if i is not None and any(x in (t or "") for x in items)} <= gone
        if name == "secret scans":
            assert set(left) == set(before)
            assert all(left[i] == secret_scan.masked(t, secret_scan.scan(t or "")[1]) for i, t in before.items())
        docs = after


def test_pipeline_judges_rows_without_an_id_or_with_a_repeated_one(spark, small):
    docs = read(spark, small, "documents")
    item = read(spark, small, "benchmark").where("length(text) > 60").orderBy("item_id").first().text
    text = " ".join(f"word{i} of some text" for i in range(40))
    copies = [(None, text), (None, text + " more"), (7, text), (7, text), (9, text), (7, "quite another text of the same number"),
              (None, f"{text[:90]} {item} {text[:90]}"), (None, ""), (8, None), (8, None)]
    rows = spark.createDataFrame(copies, "doc_id long, text string")
    for c in docs.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    rows = rows.select(docs.columns).withColumn("Row_Key", F.lit(1))
    alone = corpus_pipeline.near_duplicate_stage(spark, rows, small)
    left = [(r.doc_id, r.text) for r in alone.collect()]
    assert alone.columns == rows.columns
    assert sorted(left, key=repr) == sorted([(7, text), *copies[5:]], key=repr)
    clean = corpus_pipeline.decontamination_stage(spark, rows, small)
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=repr) == sorted(copies[:6] + copies[7:], key=repr)


def test_pipeline_of_an_empty_table(spark, small):
    docs = read(spark, small, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small))
    assert docs.count() == 0
