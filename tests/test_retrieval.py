import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import bm25, context, dedupe, keywords, papers, quality, ranking, vectors
from ragspark.operators.embedding import model_embedder

VECTOR = "id long, g string, embedding array<float>"


@pytest.fixture(scope="module")
def cloud(spark):
    """300 vectors; one scope holds more than a third of them, and a third of all are copies of one vector."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        v = np.ones(8) if i % 3 == 0 else np.round(rng.standard_normal(8), 1)
        rows.append((i, "hot" if i % 5 < 3 else f"g{i % 7}", [float(x) for x in v]))
    return rows, spark.createDataFrame(rows, VECTOR)


def cosine(a, b):
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_nearest_equals_brute_force(cloud, block_rows):
    rows, df = cloud
    got = vectors.nearest(df, df.withColumnRenamed("id", "other"), 4, scope=["g"], query_key="id", corpus_key="other",
                          block_rows=block_rows)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append((r.rank, r.other))
    for i, g, v in rows:
        best = sorted(((-cosine(v, w), j) for j, h, w in rows if h == g))[:4]
        assert [o for _, o in sorted(found[i])] == [j for _, j in best]


def test_vectors_of_other_dimension_never_meet(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0])], VECTOR)
    got = vectors.nearest(df, df.withColumnRenamed("id", "other"), 5, scope=["g"], query_key="id", corpus_key="other")
    assert sorted((r.id, r.other) for r in got.collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("leaders", [1000, 5])
def test_greedy_prune(cloud, leaders):
    rows, df = cloud
    kept = {}
    for i, g, v in rows:
        if all(cosine(v, w) <= 0.6 for w in kept.get(g, {}).values()):
            kept.setdefault(g, {})[i] = v
    got = dedupe.prune_near_duplicates(df, [F.col("id")], key="id", scope="g", threshold=0.6, leaders=leaders, block_rows=16)
    assert sorted(r.id for r in got.collect()) == sorted(i for g in kept.values() for i in g)


def test_prune_is_not_transitive(spark):
    rows = [(1, "q", [1.0, 0.0]), (2, "q", [0.92, 0.39]), (3, "q", [0.7, 0.71]), (4, "q", [0.0, 0.0]), (5, "q", [0.0, 0.0])]
    got = dedupe.prune_near_duplicates(spark.createDataFrame(rows, VECTOR), [F.col("id")], key="id", scope="g")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_similar_pairs(cloud):
    rows, df = cloud
    want = {(i, j) for i, g, v in rows for j, h, w in rows if g == h and i < j and cosine(v, w) > 0.7}
    got = vectors.similar_pairs(df, 0.7, scope=["g"], key="id", block_rows=16)
    assert {(r.left_id, r.right_id) for r in got.collect()} == want


def test_approximate_search_finds_most(spark, small):
    from ragspark.registry import tables
    queries = tables.passage_queries(spark, small)
    corpus = tables.collections(spark, small)
    exact = {(r.query_id, r.chunk_id) for r in vectors.nearest(queries, corpus, 3, scope=["book_uid"]).collect()}
    near = {(r.query_id, r.chunk_id) for r in
            vectors.nearest_approximate(queries, corpus, 3, 64, scope=["book_uid"]).collect()}
    assert len(exact & near) / len(exact) > 0.7
    all_of_them = vectors.nearest_approximate(queries, corpus, 3, 64, scope=["book_uid"], bits=0, tables=1)
    assert {(r.query_id, r.chunk_id) for r in all_of_them.collect()} == exact


def test_token_budget(spark):
    rows = [("a", 1, 9.0, 400), ("a", 2, 8.0, 300), ("a", 3, 7.5, 0), ("a", 4, 7.0, 250), ("a", 5, 6.0, 0), ("a", 6, 5.0, 100),
            ("b", 1, 1.0, 0), ("b", 2, 1.0, 5)]
    df = spark.createDataFrame(rows, "query_id string, rank int, rerank_score double, token_estimate int")
    got = ranking.token_budget(df, [-F.col("rerank_score"), F.col("rank")])
    assert sorted((r.query_id, r.rank) for r in got.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]


def test_threshold_and_gate(spark):
    df = spark.createDataFrame([("q", 1, .31), ("q", 2, .29), ("q", 3, .2), ("r", 1, .29)], "query_id string, rank int, similarity double")
    assert ranking.similar_enough(df, 0.3).count() == 1
    assert ranking.top_hit_gate(df).count() == 3


def test_relative_scores(spark):
    df = spark.createDataFrame([("q", i, s) for i, s in enumerate([3, 2, 2, 1])] + [("z", 0, 0)], "query_id string, i int, s int")
    got = [(r.similarity_score, r.match_percentage) for r in ranking.relative_score(df, "s").orderBy("query_id", "i").collect()]
    assert got == [(1.0, 100.0), (.6667, 66.67), (.6667, 66.67), (.3333, 33.33), (0.0, 0.0)]


def test_page_bounds():
    assert ranking.page_bounds(0, 500) == (1, 100)
    assert ranking.page_bounds(3, 0) == (3, 20)
    assert ranking.page_bounds("2", None) == (1, 20)


def test_weak_rows_stay_only_without_strong_ones(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 1.0), ("b", 1, 1.0)], "query_id string, rank int, rerank_score double")
    assert sorted((r.query_id, r.rank) for r in context.drop_low_rerank(df).collect()) == [("a", 1), ("b", 1)]


def test_fallback_rows(spark):
    rows = [("q", "x", i, f"u{i}", None if i == 1 else "0.9", "short") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id string, query string, pos int, url string, score string, content string")
    assert sorted(r.pos for r in quality.filter_with_fallback(df).collect()) == [0, 1, 2]
    reasons = {r.reason: r.rows for r in quality.rejection_audit(df).collect()}
    assert reasons == {"missing_field": 1, "short_content": 4}


def test_bm25_fills_up(spark):
    docs = spark.createDataFrame([(i, f"common w{i} w{i} v{i}") for i in range(8)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "w3 W3 w3"), ("b", "common"), ("c", "")], "query_id string, query string")
    index = bm25.build_index(docs)
    assert index.documents == 8 and index.mean_length == 4.0
    got = {}
    for r in bm25.search_filled(asked, docs, index, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    assert [d for _, d, _ in sorted(got["a"])] == [3, 0, 1]
    assert [d for _, d, _ in sorted(got["b"])] == [0, 1, 2] and all(s > 0 for _, _, s in got["b"])
    assert [(d, s) for _, d, s in sorted(got["c"])] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    idf = np.log(8 - 1 + .5) - np.log(1.5)
    assert sorted(got["a"])[0][2] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5))


def test_bm25_where_common_terms_count_against_a_document(spark):
    docs = spark.createDataFrame([(i, "same words" if i < 9 else "other") for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "same")], "query_id string, query string")
    index = bm25.build_index(docs)
    assert index.mean_idf < 0
    got = bm25.search_filled(asked, docs, index, 4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [9, 10, 11, 0] and got[3].score < 0


def test_bm25_ranks_zero_scores_with_unmatched_documents(spark):
    docs = spark.createDataFrame([(i, f"half w{i} x{i}" if i >= 4 else f"w{i} x{i}") for i in range(8)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "half"), ("b", "half w5")], "query_id string, query string")
    index = bm25.build_index(docs)
    got = bm25.search_filled(asked, docs, index, 3).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 5, 0, 1] and [r.score > 0 for r in got] == [False] * 3 + [True, False, False]


def test_bm25_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} x{i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"w{i}") for i in range(6)], "query_id string, query string")
    index = bm25.build_index(docs)
    want = bm25.search_filled(asked, docs, index, 15).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 2)
    assert bm25.search_filled(asked, docs, index, 15).orderBy("query_id", "rank").collect() == want and len(want) == 90


def test_a_whole_scope_is_never_sent_to_one_task(spark, cloud):
    heads = ranking.top_k(cloud[1], ["g"], [F.col("id").asc()], inspect.signature(dedupe.prune_near_duplicates).parameters["leaders"].default)
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()


def test_keyword_overlap(spark):
    books = spark.createDataFrame([(1, "Red Bolt", "Ann", None, "für x"), (2, "Blue", "Bo", "Tools", "bolted red")],
                                  "book_id long, title string, author string, category string, summary string")
    asked = spark.createDataFrame([("q", "RED bolt o Für  red"), ("r", "zzz")], "query_id string, query string")
    got = {(r.query_id, r.book_id): r.score for r in keywords.overlap_scores(asked, books).collect()}
    assert got == {("q", 1): 4, ("q", 2): 3}


def test_subscription_falls_back_to_closed_papers(spark):
    rows = [("a", 1, "IEEE Press", True), ("a", 2, "", False), ("b", 1, None, True), ("b", 2, "MIT", False)]
    df = spark.createDataFrame(rows, "query_id string, i int, publisher string, is_oa boolean")
    assert sorted((r.query_id, r.i) for r in papers.access_filter(df, "subscription").collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        papers.access_filter(df, "free")


def test_first_seen_counts_missing_titles_as_one(spark):
    df = spark.createDataFrame([("q", 2, None), ("q", 1, None), ("q", 0, "t"), ("q", 3, "t")], "query_id string, pos int, title string")
    assert sorted(r.pos for r in papers.dedupe_titles(df).collect()) == [0, 1]


def test_model_embedder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    df = spark.createDataFrame([("a  b",), ("",)], "t string")
    assert [r.e for r in model_embedder(load)(df, "t", "e").collect()] == [[3.0, 1.0], [7.0, 1.0]]


def test_plans(spark, small):
    from ragspark import registry
    registry.load()
    text = {n: registry.QUERIES[n](spark, small)._jdf.queryExecution().executedPlan().toString()
            for n in ("score_top_k", "first_seen_titles", "unprocessed_books", "token_budget")}
    assert all("WindowGroupLimit" in text[n] for n in ("score_top_k", "first_seen_titles", "token_budget"))
    scan = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in plan
