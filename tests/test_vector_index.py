"""The trained vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import vector_index as vi
from ragspark.operators import vectors


def frame(spark, rows, name="chunk_id"):
    return spark.createDataFrame([(i, s, [float(x) for x in v] if v is not None else None) for i, s, v in rows],
                                 f"{name} long, shelf string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def grouped(spark):
    """3,000 vectors in 60 groups, and queries near the groups."""
    r = np.random.default_rng(5)
    middles = r.standard_normal((60, 24))
    rows = [(i, "a" if i % 3 else "b", middles[i % 60] + 0.25 * r.standard_normal(24)) for i in range(3000)]
    asked = [(i, "a" if i % 2 else "b", middles[i % 60] + 0.25 * r.standard_normal(24)) for i in range(150)]
    return frame(spark, rows), frame(spark, asked, "query_id")


def found(df):
    return {(r.query_id, r.rank): (r.chunk_id, round(r.similarity, 6)) for r in df.collect()}


def test_grouped_vectors_need_few_lists(grouped):
    corpus, asked = grouped
    row = vi.recall_report(asked, corpus, vi.build_index(corpus, 24), 5).first()
    assert (row.queries, row.neighbours) == (150, 750)
    assert row.recall >= 0.9 and row.share_by_code < 0.1 and row.share_exact < 0.02


def test_found_rows_have_exact_similarities(grouped):
    corpus, asked = grouped
    every = vi.search(asked, vi.build_index(corpus, 24, lists=8), 5, short=200, probes=8)
    assert found(every) == found(vectors.nearest(asked, corpus, 5))


def test_scopes_and_blocks(grouped):
    corpus, asked = grouped
    index = vi.build_index(corpus, 24, scope=["shelf"], lists=4)
    want = vectors.nearest(asked, corpus, 3, scope=["shelf"])
    assert found(vi.search(asked, index, 3, short=300, probes=4)) == found(want)
    small = vi.short_lists(asked, index, 50, probes=4, block_rows=64)
    large = vi.short_lists(asked, index, 50, probes=4)
    assert {tuple(r)[:4] for r in small.collect()} == {tuple(r)[:4] for r in large.collect()}


def test_copies_nulls_zeros_and_other_lengths(spark):
    rows = ([(i, "s", [1, 2, 3]) for i in range(40)] + [(50, "s", None), (51, "s", []), (52, "s", [1, 2]), (53, "s", [0, 0, 0]),
                                                        (54, "s", [-1, 0, 2]), (55, None, [3, 2, 1])])
    corpus, asked = frame(spark, rows), frame(spark, [(1, "s", [1, 2, 3]), (2, "s", [3, 2, 1]), (3, "s", None), (4, "s", [1, 2])], "query_id")
    index = vi.build_index(corpus, 3)
    got = found(vi.search(asked, index, 3, short=60, probes=len(index.centroids)))
    assert [got[1, n][0] for n in (1, 2, 3)] == [0, 1, 2] and got[2, 1] == (55, 1.0) and {q for q, _ in got} == {1, 2}
    assert index.coded.count() == 43


def test_codes_are_read_by_list_and_without_vectors(grouped):
    corpus, asked = grouped
    index = vi.build_index(corpus, 24)
    assert "list" in {f.split("=")[0].rsplit("/", 1)[-1] for f in index.coded.inputFiles()[0].split("/") if "=" in f}
    plan = vi.short_lists(asked, index, 20)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "ReadSchema" in line and "code:binary" in line]
    assert reads and all("_v:" not in line.split("ReadSchema")[1] for line in reads)


def test_empty(spark, grouped):
    corpus, asked = grouped
    index = vi.build_index(corpus.where("false"), 24)
    assert vi.search(asked, index, 3).count() == 0
    assert vi.search(asked.where("false"), vi.build_index(corpus, 24, lists=4), 3).count() == 0
    assert vi.build_index(corpus.where(F.lit(False)), 24).probes >= 1


def test_pruning_decides_in_few_rounds(spark, monkeypatch):
    """One scope of 12,000 rows in loose groups and a long chain, against the row-by-row walk."""
    from ragspark.operators import dedupe
    r = np.random.default_rng(9)
    middles = r.standard_normal((300, 16))
    loose = [middles[i % 300] + 0.22 * r.standard_normal(16) for i in range(11_900)]
    chain = [np.r_[np.cos(i * 0.2), np.sin(i * 0.2), np.zeros(14)] for i in range(100)]
    vectors_ = np.array(loose + chain, dtype=np.float32)
    order = r.permutation(len(vectors_))
    rows = [(1, i, int(order[i]), v.tolist()) for i, v in enumerate(vectors_)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, place long, embedding array<float>").repartition(8)
    rounds, one = [], dedupe._round

    def counted(*args):
        rounds.append(1)
        return one(*args)

    monkeypatch.setattr(dedupe, "_round", counted)
    got = dedupe.prune_near_duplicates(df, [F.col("place")], key="chunk_id", threshold=0.9, leaders=50, block_rows=1024)
    units = vectors_.astype(float) / np.linalg.norm(vectors_.astype(float), axis=1, keepdims=True)
    kept = []
    for i in np.argsort(order):
        if not kept or not (np.round(units[kept] @ units[i], 9) > 0.9).any():
            kept.append(i)
    assert sorted(x.chunk_id for x in got.select("chunk_id").collect()) == sorted(int(i) for i in kept)
    assert 1 < len(rounds) < 20 and len(kept) > 300
