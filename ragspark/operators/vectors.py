"""Exact and approximate nearest neighbours, similar pairs and checks over vector tables.

The work is done block against block: Spark spreads the rows, each task multiplies bounded matrices and emits
only what survives (k rows per query, or pairs above a threshold). No join ever emits all pairs of a group.

Both sides are cut into tiles of bounded size by a hash of their ids, and each pair of tiles of one scope is a group
of its own, so a scope that holds a third of all rows becomes many groups. The plan is the same at every size. A row
moves once for every tile of the other side, so tiles are as large as a task can hold; blocks are cut from them inside the
task. Neighbours are looked for in single precision first: what cannot reach the k-th best value found so far, by
more than the rounding could hide, is left out, and the rest is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import vectors as vx
from ragspark.operators.ranking import top_k

BLOCK_ROWS = 2048  # two blocks give at most 4 million scores, about 32 MB a matrix
TILE_VALUES = 1 << 22  # numbers of one tile of corpus vectors: 32 MB in double precision; tiles of queries are a quarter
DIGITS = 9  # similarities are rounded before they are compared, so block shapes cannot reorder equal vectors


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_pylist())


def _closeness(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Cosine similarity, or minus the squared distance, of every row of ``left`` with every row of ``right``."""
    if metric == "l2":
        square = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
        return -np.round(np.maximum(square, 0.0), DIGITS) + 0.0
    lengths = [np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right)]
    scaled = [m / np.where(n == 0, 1.0, n) for m, n in zip((left, right), lengths)]
    return np.round(scaled[0] @ scaled[1].T, DIGITS) + 0.0


def _best(owner: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int):
    """First k entries per owner by falling value, then by id."""
    order = np.lexsort((ids, -value, owner))
    owner, ids, value = owner[order], ids[order], value[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], dtype=int)
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = place < k
    return owner[keep], ids[keep], value[keep]


def _candidates(scores: np.ndarray, k: int):
    """Row and column numbers of entries not below the k-th best of their row, ties included."""
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        return np.nonzero(scores >= floor)
    return np.nonzero(np.ones_like(scores, dtype=bool))


def _tile_best(q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, metric: str, rows: int):
    """Per row of ``q`` its k best rows of ``c``: row numbers, ids and values. ``rows`` bounds the matrices."""
    finite = np.isfinite(q).all() and np.isfinite(c).all()
    found = []
    for start in range(0, len(q), rows):
        some = q[start:start + rows]
        best = (np.zeros(0, int), c_ids[:0], np.zeros(0))
        floor = np.full(len(some), -np.inf)
        for at in range(0, len(c), rows):
            owner, of, value = _passing(some, c[at:at + rows], floor, k, metric, finite)
            if not len(owner):
                continue
            best = _best(np.r_[best[0], owner], np.concatenate([best[1], c_ids[at:at + rows][of]]), np.r_[best[2], value], k)
            full = np.bincount(best[0], minlength=len(some)) == k
            last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
            lowest = np.full(len(some), -np.inf)
            lowest[best[0][last]] = best[2][last]
            floor = np.where(full & finite, lowest, -np.inf)
        found.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _passing(left: np.ndarray, right: np.ndarray, floor: np.ndarray, k: int, metric: str, finite: bool):
    """Row numbers of both sides and values of all pairs among a row's k best here that reach its floor."""
    if finite:
        with np.errstate(over="ignore", invalid="ignore"):
            rough, slack = _rough(left, right, metric)
        if np.isfinite(rough).all():
            if np.isneginf(floor).any() and rough.shape[1] > k:
                floor = np.maximum(floor, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - slack)
            at, of = np.nonzero(rough >= (floor - slack).astype("float32")[:, None])
            if len(at) <= 8 * k * len(left):
                return at, of, _pair_values(left, right, at, of, metric)
    scores = _closeness(left, right, metric)
    at, of = _candidates(scores, k)
    value = scores[at, of]
    keep = ~(value < floor[at])
    return at[keep], of[keep], value[keep]


def _rough(left: np.ndarray, right: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Closeness in single precision, and more than it may differ from the rounded one in double precision."""
    unit = 2.0 ** -23 * 2 * (left.shape[1] + 8)
    if metric == "l2":
        squares = [(m**2).sum(1) for m in (left, right)]
        rough = 2 * (left.astype("float32") @ right.astype("float32").T)
        rough -= squares[0].astype("float32")[:, None]
        rough -= squares[1].astype("float32")[None, :]
        return rough, 2 * unit * (squares[0].max() + squares[1].max()) + 1e-8
    lengths = [np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right)]
    scaled = [(m / np.where(n == 0, 1.0, n)).astype("float32") for m, n in zip((left, right), lengths)]
    return scaled[0] @ scaled[1].T, unit + 1e-8


def _pair_values(left: np.ndarray, right: np.ndarray, at: np.ndarray, of: np.ndarray, metric: str) -> np.ndarray:
    """The values of ``_closeness`` for some pairs."""
    values = np.empty(len(at))
    norms = [np.linalg.norm(m, axis=1) for m in (left, right)]
    for start in range(0, len(at), 65_536):
        a, b = at[start:start + 65_536], of[start:start + 65_536]
        if metric == "l2":
            square = norms[0][a]**2 + norms[1][b]**2 - 2 * np.einsum("ij,ij->i", left[a], right[b])
            values[start:start + 65_536] = -np.round(np.maximum(square, 0.0), DIGITS)
        else:
            one, two = (m[x] / np.where(n[x] == 0, 1.0, n[x])[:, None] for m, n, x in ((left, norms[0], a), (right, norms[1], b)))
            values[start:start + 65_536] = np.round(np.einsum("ij,ij->i", one, two), DIGITS)
    return values + 0.0


def _prepare(df: DataFrame, scope: list[str], key: str, vector: str) -> DataFrame:
    """``(_s, _id, _v)``: the scope includes the dimension, so vectors of different length never meet."""
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    parts = [F.col(c).cast("string") for c in scope] + [F.size(vector).cast("string")]
    return usable.select(F.to_json(F.array(*parts)).alias("_s"), F.col(key).alias("_id"), F.col(vector).alias("_v"))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Adds the row's block ``_b`` and the number of blocks ``_n`` of its scope."""
    counts = df.groupBy("_s").agg(F.ceil(F.count("*") / rows).cast("int").alias("_n"))
    return df.join(counts, "_s").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))


def _tiles(df: DataFrame, rows: int, share: int) -> DataFrame:
    """As ``_blocks`` with as many rows as fit ``TILE_VALUES / share`` numbers, and ``rows`` at least."""
    size = F.greatest(F.lit(rows), F.floor(F.lit(TILE_VALUES // share) / F.max(F.size("_v"))))
    counts = df.groupBy("_s").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
    return df.join(counts, "_s").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    scope: list[str] | None = None,
    query_key: str = "query_id",
    corpus_key: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest corpus rows per query: ``(query_id, corpus_key, similarity | distance, rank)``.

    ``scope`` names columns both sides share; a query only meets rows of its own scope.
    """
    left = _prepare(queries, scope or [], query_key, vector)
    right = _prepare(corpus, scope or [], corpus_key, vector)
    out = T.StructType([
        T.StructField("_q", left.schema["_id"].dataType),
        T.StructField("_id", right.schema["_id"].dataType),
        T.StructField("_c", T.DoubleType()),
    ])
    hits = _grouped_best(left, right, k, metric, block_rows, out)
    value = F.col("_c") if metric == "cosine" else -F.col("_c") + F.lit(0.0)
    best = top_k(hits, ["_q"], [F.desc("_c"), F.asc("_id")], k)
    return best.select(
        F.col("_q").alias(query_key),
        F.col("_id").alias(corpus_key),
        value.alias("similarity" if metric == "cosine" else "distance"),
        "rank",
    )


def _grouped_best(left, right, k: int, metric: str, block_rows: int, out: T.StructType) -> DataFrame:
    left, right = _tiles(left, block_rows, 4), _tiles(right, block_rows, 1)
    across_left = right.select("_s", F.col("_n").alias("_m")).distinct()
    across_right = left.select("_s", F.col("_n").alias("_m")).distinct()
    left = left.join(across_left, "_s").select(
        "_s", F.col("_b").alias("_lb"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_rb"), "_id", "_v")
    right = right.join(across_right, "_s").select(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_lb"), F.col("_b").alias("_rb"), "_id", "_v")
    names = ["_q", "_id", "_c"]

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"_q": a["_id"].slice(0, 0), "_id": b["_id"].slice(0, 0),
                             "_c": pa.array([], pa.float64())})
        at, ids, value = _tile_best(_matrix(a["_v"]), _ids(b["_id"]), _matrix(b["_v"]), k, metric, block_rows)
        return pa.table([a["_id"].take(pa.array(at)), pa.array(ids, type=b["_id"].type), pa.array(value, type=pa.float64())],
                        names=names)

    key = ["_s", "_lb", "_rb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(multiply, out)


def similar_pairs(
    df: DataFrame,
    threshold: float,
    *,
    scope: list[str],
    key: str,
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of one scope with cosine above the threshold: ``(left_id, right_id, similarity)``, smaller id left."""
    rows = _blocks(_prepare(df, scope, key, vector), block_rows)
    left = rows.select(
        "_s", F.col("_b").alias("_lb"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_rb"), "_id", "_v")
    again = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    right = again.select(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_lb"), F.col("_b").alias("_rb"), "_id", "_v")
    out = T.StructType([
        T.StructField("left_id", rows.schema["_id"].dataType),
        T.StructField("right_id", rows.schema["_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])

    def compare(key_values, a: pa.Table, b: pa.Table) -> pa.Table:
        kind = (a if a.num_rows else b)["_id"].type
        first, second, value = [], [], []
        if a.num_rows and b.num_rows:
            a_ids, b_ids = _ids(a["_id"]), _ids(b["_id"])
            scores = _closeness(_matrix(a["_v"]), _matrix(b["_v"]), "cosine")
            at, of = np.nonzero(scores > threshold)
            if key_values[1].as_py() == key_values[2].as_py():
                ordered = a_ids[at] < b_ids[of]
                at, of = at[ordered], of[ordered]
            swap = a_ids[at] > b_ids[of]
            first = np.where(swap, b_ids[of], a_ids[at])
            second = np.where(swap, a_ids[at], b_ids[of])
            value = scores[at, of]
        return pa.table({"left_id": pa.array(first, type=kind), "right_id": pa.array(second, type=kind),
                         "similarity": pa.array(value, type=pa.float64())})

    group = ["_s", "_lb", "_rb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, out)


def _sign_buckets(df: DataFrame, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per hash table: the signs of ``bits`` fixed random projections of the vector."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    kind = df.schema["_id"].dataType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = (_matrix(batch["_v"]) @ planes > 0).reshape(batch.num_rows, tables, bits)
            codes = (signs * weights).sum(2)
            for table in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [batch["_s"], batch["_id"], batch["_v"],
                     pa.array(np.full(batch.num_rows, table), pa.int32()), pa.array(codes[:, table], pa.int32())],
                    names=["_s", "_id", "_v", "_t", "_code"],
                )

    return df.mapInArrow(project, T.StructType([
        df.schema["_s"], T.StructField("_id", kind), df.schema["_v"],
        T.StructField("_t", T.IntegerType()), T.StructField("_code", T.IntegerType()),
    ]))


def nearest_approximate(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dim: int,
    *,
    scope: list[str] | None = None,
    query_key: str = "query_id",
    corpus_key: str = "chunk_id",
    vector: str = "embedding",
    tables: int = 12,
    bits: int = 4,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate k nearest by cosine: rows that share a sign bucket with the query in any table, scored exactly.

    Buckets are scopes of the block product above, so a bucket full of copies is cut into blocks like any hot scope.
    """
    sides = [
        _sign_buckets(_prepare(df.where(F.size(vector) == dim), scope or [], key, vector), dim, tables, bits, seed)
        for df, key in ((queries, query_key), (corpus, corpus_key))
    ]
    left, right = (
        s.select(F.concat_ws("/", "_s", "_t", "_code").alias("_s"), "_id", "_v") for s in sides
    )
    out = T.StructType([
        T.StructField("_q", left.schema["_id"].dataType),
        T.StructField("_id", right.schema["_id"].dataType),
        T.StructField("_c", T.DoubleType()),
    ])
    hits = _grouped_best(left, right, k, "cosine", block_rows, out)
    once = hits.groupBy("_q", "_id").agg(F.max("_c").alias("_c"))
    best = top_k(once, ["_q"], [F.desc("_c"), F.asc("_id")], k)
    return best.select(F.col("_q").alias(query_key), F.col("_id").alias(corpus_key),
                       F.col("_c").alias("similarity"), "rank")


def embedding_report(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Count, dimension, norms and whether all vectors have unit length, per collection."""
    sized = vectors.select(*by, F.size(vector).alias("_dim"), vx.norm(F.col(vector)).alias("_norm"))
    return sized.groupBy(*by).agg(
        F.count("*").alias("total_embeddings"),
        F.min("_dim").alias("min_dim"),
        F.max("_dim").alias("max_dim"),
        F.round(F.min("_norm"), 5).alias("min_norm"),
        F.round(F.max("_norm"), 5).alias("max_norm"),
        F.bool_and(F.abs(F.col("_norm") - 1) <= 1e-5 + 1e-8).alias("all_normalized"),
    )


def dimension_check(queries: DataFrame, corpus: DataFrame, scope: str, vector: str = "embedding") -> DataFrame:
    """One row per query: whether its collection exists and has vectors of the query's dimension."""
    dims = corpus.groupBy(scope).agg(F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"))
    joined = queries.join(dims, scope, "left")
    size = F.size(vector)
    return joined.select(
        "query_id",
        scope,
        F.when(F.col("_lo").isNull(), "embeddings_missing")
        .when((size < F.col("_lo")) | (size > F.col("_hi")), "chroma_embedding_dimension_mismatch")
        .otherwise("ok").alias("status"),
        size.alias("query_dim"),
        F.col("_hi").alias("collection_dim"),
    )
