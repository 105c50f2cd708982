"""Early stopping against the full ranking."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import bm25, bm25_blocks


@pytest.fixture(scope="module")
def corpus(spark):
    """2,000 documents; neighbours by id share their rare words, all share the frequent ones."""
    r = random.Random(6)
    rows = [(i, " ".join([f"topic{i // 50}word{r.randrange(20)}" for _ in range(r.randrange(1, 12))]
                         + r.choices(["the", "of", "and", "to"], [8, 4, 2, 1], k=r.randrange(5, 60)))) for i in range(2000)]
    rows += [(5000 + i, t) for i, t in enumerate([None, "", "  ", "alone", "the the the"])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in df.collect())


def test_same_rows_as_the_full_ranking(spark, corpus):
    r = random.Random(1)
    asked = [(i, f"topic{r.randrange(40)}word{r.randrange(20)} topic{r.randrange(40)}word3 the of") for i in range(60)]
    asked += [(100, "the"), (101, "absent words"), (102, None), (103, "alone alone"), (104, "to of and the")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = bm25.build_index(corpus)
    for k in (1, 7):
        want = rows_of(bm25.search(queries, index, k))
        for postings in (300, 2_000, 1_000_000):
            assert rows_of(bm25_blocks.search(queries, bm25_blocks.block_index(index, block_postings=postings), k)) == want


def test_few_blocks_are_scored(spark, corpus):
    queries = spark.createDataFrame([(i, f"topic{i}word1 topic{i}word2 topic{i}word5 the of") for i in range(40)],
                                    "query_id long, query string")
    index = bm25_blocks.block_index(bm25.build_index(corpus), block_postings=250)
    seen = bm25_blocks.visited_blocks(queries, index, 5).agg(F.sum("blocks").alias("blocks"), F.sum("visited").alias("visited")).first()
    assert seen.visited < 0.25 * seen.blocks


def test_frequent_words_that_count_against_a_document(spark):
    docs = spark.createDataFrame([(i, "same words" if i < 9 else "same other") for i in range(10)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "same"), (2, "words same"), (3, "other")], "query_id long, query string")
    index = bm25.build_index(docs)
    blocks = bm25_blocks.block_index(index, block_postings=4)
    assert rows_of(bm25_blocks.search(queries, blocks, 3)) == rows_of(bm25.search(queries, index, 3))


def test_text_keys_and_empty_sides(spark, corpus):
    named = corpus.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text")
    queries = spark.createDataFrame([("a", "topic3word1 the"), ("b", "of")], "query_id string, query string")
    index = bm25.build_index(named, key="name")
    blocks = bm25_blocks.block_index(index, key="name", block_postings=900)
    want = [tuple(r) for r in bm25.search(queries, index, 4, key="name").orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in bm25_blocks.search(queries, blocks, 4).orderBy("query_id", "rank").collect()] == want
    assert bm25_blocks.search(queries.where("false"), blocks, 4).count() == 0
    nothing = bm25.build_index(corpus.where("false"))
    assert bm25_blocks.search(queries, bm25_blocks.block_index(nothing), 4).count() == 0


def test_terms_that_are_not_essential():
    r = np.random.default_rng(2)
    for _ in range(200):
        parts = []
        for _ in range(r.integers(1, 6)):
            docs = np.flatnonzero(r.random(30) < r.random())
            impacts = r.random(len(docs)) * 2
            parts.append((r.random() * r.choice([1, 3, -0.2]), impacts.max(initial=0.0), docs, impacts))
        total, seen = np.zeros(30), np.zeros(30, bool)
        for weight, _, docs, impacts in parts:
            total[docs] += weight * impacts
            seen[docs] = True
        order = sorted(np.flatnonzero(seen), key=lambda d: (-round(total[d], 9), d))
        least = round(float(total[order[min(2, len(order) - 1)]]), 9) if order else None
        at, scores = bm25_blocks.best_of_block(parts, 30, 4, least)
        want = [d for d in order if least is None or round(total[d], 9) >= least][:4]
        assert at.tolist() == want and np.allclose(scores, total[want])
