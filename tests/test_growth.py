"""Steps whose size must follow the input and not its square, a batch or a group."""

import numpy as np
from pyspark.sql import functions as F

from ragspark.operators import bm25, bm25_blocks, embedding, keywords, vector_index, vectors
from ragspark.sources.files import spread


def table(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, embedding array<float>")


def test_tiles_hold_many_blocks(spark, monkeypatch):
    rows = np.random.default_rng(3).standard_normal((300, 6)).astype("float32")
    rows[7] = rows[8] = rows[9]
    rows[11] = 0
    corpus, asked = table(spark, rows, "chunk_id"), table(spark, rows[:40], "query_id")
    assert vectors._tiles(vectors._prepare(corpus, [], "chunk_id", "embedding"), 16, 4).agg(F.max("_n")).first()[0] == 1
    exact = rows.astype("float64")
    units = exact / np.where(np.linalg.norm(exact, axis=1) == 0, 1, np.linalg.norm(exact, axis=1))[:, None]
    close = {"cosine": np.round(units @ units.T, 9),
             "l2": -np.round(((exact[:, None] - exact[None]) ** 2).sum(2), 9)}
    for values in (1 << 22, 6 * 50):
        monkeypatch.setattr(vectors, "TILE_VALUES", values)
        for metric, scores in close.items():
            got = vectors.nearest(asked, corpus, 4, metric=metric, block_rows=16).collect()
            want = {(q, c, at + 1) for q in range(40) for at, c in enumerate(np.lexsort((np.arange(300), -scores[q]))[:4])}
            assert {(r.query_id, r.chunk_id, r.rank) for r in got} == want


def test_far_vectors_fall_back_to_double_precision():
    rows = np.random.default_rng(5).standard_normal((120, 3)) + 1e4
    at, ids, value = vectors._tile_best(rows, np.arange(120), rows, 3, "l2", 32)
    scores = vectors._closeness(rows, rows, "l2")
    assert np.allclose(value.reshape(120, 3), -np.sort(-scores, axis=1)[:, :3], atol=1e-6) and len(at) == 360


def test_short_lists_by_tiles(spark, monkeypatch):
    rows = np.random.default_rng(4).standard_normal((300, 8)).astype("float32")
    corpus, asked = table(spark, rows, "chunk_id"), table(spark, rows[:40] + 0.1, "query_id")
    index = vector_index.build_index(corpus, 8, lists=5)
    prepared = vectors._prepare(asked, [], "query_id", "embedding")
    assert vector_index._probes_by_list(prepared, index).agg(F.sum("n")).first()[0] == 40 * min(index.probes, 5)
    monkeypatch.setattr(vectors, "TILE_VALUES", 8 * 60)
    listed = vector_index.short_lists(asked, index, 30, probes=5, block_rows=16)
    assert listed.groupBy("_q").count().where("count = 30").count() == 40
    found = vector_index.search(asked, index, 3, short=300, probes=5).select("query_id", "chunk_id", "rank").collect()
    assert set(found) == set(vectors.nearest(asked, corpus, 3).select("query_id", "chunk_id", "rank").collect())


def test_bm25_tasks_follow_the_sums(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q}") for q in range(10)], "query_id long, query string")
    index = bm25.build_index(docs)
    want = bm25.search(asked, index, 3).collect()
    monkeypatch.setattr(bm25, "SUMS_PER_TASK", 20)
    plan = bm25.scores(asked, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "], 30" in plan
    assert sorted(bm25.search(asked, index, 3).collect()) == sorted(want)


def test_an_embedder_takes_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    texts = [None, "", *("word " * 50 for _ in range(700))]
    parts = list(embedding._slices(pa.array(texts)))
    assert max(map(len, parts)) <= 256 and [t for p in parts for t in p] == texts
    monkeypatch.setattr(embedding, "SLICE_CHARS", 1000)
    assert max(sum(len(t or "") for t in p) for p in embedding._slices(pa.array(texts))) <= 1250
    rows = spark.createDataFrame([(i, f"a{i} b a{i}" if i % 7 else None) for i in range(600)], "id long, text string")
    got = embedding.hashing_embedder(16)(rows, "text").collect()
    assert all(len(r.embedding) == 16 and abs(np.linalg.norm(r.embedding) - bool(r.text)) < 1e-6 for r in got)


def test_overlap_rows_are_not_summed_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(keywords, "ASKERS", 2)
    books = spark.createDataFrame([(1, "red bolt"), (2, "blue bolts"), (2, "green"), (None, "red")], "book_id long, title string")
    books = books.withColumns({c: F.lit(None).cast("string") for c in ("author", "category", "summary")})
    asked = spark.createDataFrame([(1, "red bolt"), (2, "bolt RED"), (3, "green bolt"), (3, "bolt"), (None, "red"), (4, "x")],
                                  "query_id long, query string")
    got = keywords.overlap_scores(asked, books)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(1, 1, 2), (1, 2, 1), (1, None, 1), (2, 1, 2), (2, 2, 1), (2, None, 1), (3, 1, 2), (3, 2, 3), (None, 1, 1), (None, None, 1)}
    assert {(r.query_id, r.book_id, r.score) for r in got.collect()} == want and got.count() == len(want)


def test_overlap_rows_are_written_in_few_bytes(spark, tmp_path):
    books = spark.range(400).select(F.col("id").alias("book_id"), F.format_string("w%d red", F.col("id") % 40).alias("title"))
    books = books.withColumns({c: F.lit(None).cast("string") for c in ("author", "category", "summary")})
    asked = spark.range(6000).select((F.col("id") * 7919 % 6007).alias("query_id"), F.format_string("red k%d", F.col("id") % 5).alias("query"))
    path = tmp_path / "rows"
    keywords.overlap_scores(asked, books).write.parquet(str(path))
    got = spark.read.parquet(str(path))
    assert got.count() == 400 * 6000 == got.distinct().count() and got.select("score").distinct().collect() == [(1,)]
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 0.5 * 400 * 6000


def test_sums_of_few_query_terms_meet_where_the_postings_are(spark):
    docs = spark.createDataFrame([(i, f"common common w{i % 7}" if i % 9 else None) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q} w{q}") for q in range(3)], "query_id long, query string")
    index = bm25.build_index(docs)
    want = sorted(bm25.scores(asked, index).collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = bm25.scores(asked, index)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 2 and sorted(got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(want) == 3 * sum(1 for i in range(60) if i % 9)


def test_postings_count_the_words_of_long_and_empty_texts(spark):
    texts = [None, "", " \t", "a b\u2003a\x85A", *(" ".join(f"w{j % (i + 1)}" for j in range(5000)) for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in bm25.postings(docs).collect())
    assert got == sorted((i, len(t.split()), w, t.split().count(w)) for i, t in enumerate(texts) if t for w in set(t.split()))


def test_a_long_title_is_inverted_in_one_pass(spark, tmp_path):
    import time

    from ragspark.registry import flow_queries
    text = " ".join(f"w{i % 9000}" for i in range(20_000))
    spark.createDataFrame([(i, text if i < 8 else None if i == 8 else "", "s") for i in range(10)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "x") for i in range(3)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    began = time.time()
    got = {r.doi: r.abstract for r in flow_queries._source_rows(spark, str(tmp_path))[1].select("doi", "abstract").collect()}
    assert got == {f"10.9/{i}": text if i < 8 else "" for i in range(10)} and time.time() - began < 30


def test_block_lists_are_made_and_chosen_where_the_postings_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common common w{i % 7}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q}") for q in range(3)], "query_id long, query string")
    plain, plans = bm25.build_index(docs), []

    def kept(df, cut=bm25_blocks.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)
    monkeypatch.setattr(bm25_blocks, "cut_lineage", kept)
    index = bm25_blocks.block_index(plain, block_postings=30)
    assert plans[0].count("Exchange") == 1
    assert {(r.term, p.doc) for r in index.lists.collect() for p in r.postings} == {
        (r.term, r.doc_id) for r in plain.postings.collect()}
    assert index.lists.select("block", "term").distinct().count() == index.lists.count()
    assert all(r.upper == max(p.impact for p in r.postings) for r in index.lists.collect())
    got = bm25_blocks.search(asked, index, 5).collect()
    assert sorted(map(str, got)) == sorted(map(str, bm25.search(asked, plain, 5).collect()))
    assert any("LeftSemi" in p for p in plans)


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(200)), None if i % 5 else i) for i in range(4000)]
    path = str(tmp_path / "one.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, n long").coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= cores
        sizes = [r["count"] for r in spread(read).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 4000 / cores and sum(sizes) == 4000
        assert sorted(spread(read).collect(), key=lambda r: r.doc_id) == sorted(read.collect(), key=lambda r: r.doc_id)
        assert spread(read.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
