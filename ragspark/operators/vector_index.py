"""An approximate vector index: trained lists, product-quantised codes, exact scores for a short list.

Building fits two things on a bounded, repeatable sample of unit vectors: coarse centroids, whose nearest one names a
vector's list, and for each pair of dimensions 256 values, so that what a vector differs from its centroid is kept in one
byte for two dimensions. Every vector of the corpus is coded; codes lie in a table partitioned by list, so a search reads the
lists it probes and, until the end, no vector.

A search goes through the lists nearest to the query, scores their codes block against block, keeps the best ``short`` rows of
each query and scores those exactly. How many lists to probe is measured when the index is built: the least number that
finds the wanted share of true neighbours for held-out rows of the sample. Vectors in clear groups need few lists; vectors
without any structure need most of them, and then it is the codes that save the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import vectors as vx
from ragspark.operators import vectors as vec
from ragspark.operators.ranking import top_k
from ragspark.session import cut_lineage, shared_folder

SAMPLE_ROWS = 20_000
MOST_LISTS = 4096
VALUES = 256
ROUNDS = 12
HELD_OUT = 200


@dataclass(frozen=True)
class VectorIndex:
    """``coded`` is ``(list, _s, _id, code, _v)``, partitioned by list."""

    coded: DataFrame
    centroids: np.ndarray
    values: np.ndarray
    probes: int
    scope: tuple[str, ...]
    key: str

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1.0, lengths)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * rows @ centres.T).argmin(1)


def _k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of at most ``k`` groups of the rows; an empty group takes the row farthest from its centre."""
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(rows, centres)
        counts = np.bincount(owner, minlength=len(centres))
        sums = np.stack([np.bincount(owner, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-((rows - centres[owner]) ** 2).sum(1))[:(~full).sum()]
            centres[~full] = rows[far]
    return centres


def _parts(dim: int) -> list[np.ndarray]:
    """Pairs of dimensions; an odd last one stands alone."""
    return [np.arange(d, min(d + 2, dim)) for d in range(0, dim, 2)]


def _encode(rest: np.ndarray, values: np.ndarray) -> np.ndarray:
    codes = np.empty((len(rest), len(values)), np.uint8)
    for p, dims in enumerate(_parts(rest.shape[1])):
        codes[:, p] = _nearest(rest[:, dims], values[p][:, :len(dims)])
    return codes


def _decode(codes: np.ndarray, values: np.ndarray, dim: int) -> np.ndarray:
    return np.concatenate([values[p][codes[:, p], :len(dims)] for p, dims in enumerate(_parts(dim))], axis=1)


def _fit_values(rest: np.ndarray, seed: int) -> np.ndarray:
    values = np.zeros((len(_parts(rest.shape[1])), VALUES, 2))
    for p, dims in enumerate(_parts(rest.shape[1])):
        centres = _k_means(rest[:, dims], VALUES, seed + p)
        values[p, :len(centres), :len(dims)] = centres
        values[p, len(centres):, :len(dims)] = centres[:1]
    return values


def _least_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int) -> int:
    """The least number of lists that hold the wanted share of the k nearest rows of held-out rows."""
    asked = np.random.default_rng(seed).choice(len(sample), min(HELD_OUT, len(sample)), replace=False)
    owner = _nearest(sample, centroids)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, owner[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def build_index(
    corpus: DataFrame,
    dim: int,
    *,
    scope: list[str] | None = None,
    key: str = "chunk_id",
    vector: str = "embedding",
    lists: int | None = None,
    recall: float = 0.97,
    k: int = 5,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> VectorIndex:
    """The index of every vector of ``dim`` numbers; ``lists`` is the root of their count unless given.

    The sample is the rows with the least hash of their key, so it is the same in every run.
    """
    rows = vec._prepare(corpus.where(F.size(vector) == dim), scope or [], key, vector)
    counted = rows.count()
    picked = rows.orderBy(F.xxhash64("_id"), F.xxhash64("_v")).limit(sample_rows).select("_v").toArrow().column("_v")
    sample = _unit(vec._matrix(picked)) if len(picked) else np.zeros((1, dim))
    wanted = lists or int(max(1, min(MOST_LISTS, counted**0.5, len(sample) / 8)))
    centroids = _k_means(sample, wanted, seed)
    values = _fit_values(sample - centroids[_nearest(sample, centroids)], seed)
    probes = _least_probes(sample, centroids, k, recall, seed)
    names = ["list", "_s", "_id", "code", "_v"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _unit(vec._matrix(batch["_v"]))
                owner = _nearest(units, centroids)
                codes = _encode(units - centroids[owner], values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int32()), batch["_s"], batch["_id"], pa.array([c.tobytes() for c in codes], pa.binary()),
                     batch["_v"]], names=names)

    kinds = T.StructType([T.StructField("list", T.IntegerType()), rows.schema["_s"], rows.schema["_id"],
                          T.StructField("code", T.BinaryType()), rows.schema["_v"]])
    path = shared_folder(corpus.sparkSession, "vectors")
    # a list's rows meet in few files; a hot list is written by as many tasks as its rows need
    coded = rows.mapInArrow(code, kinds)
    spread = coded.repartition("list", F.pmod(F.xxhash64("_id"), F.lit(max(1, counted // (len(centroids) * 100_000)))))
    spread.write.partitionBy("list").parquet(path)
    return VectorIndex(corpus.sparkSession.read.schema(kinds).parquet(path), centroids, values, probes, tuple(scope or ()), key)


def _probes_by_list(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """``(_s, list, n)``: how many queries of a scope go through a list, counted in each task."""
    centroids, probes = index.centroids, index.probes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = _first_lists(_unit(vec._matrix(batch["_v"])), centroids, probes)
                pairs = pa.table({"_s": batch["_s"].take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))),
                                  "list": pa.array(best.ravel(), pa.int32())})
                yield from pairs.group_by(["_s", "list"]).aggregate([([], "count_all")]).rename_columns(
                    ["_s", "list", "n"]).to_batches()

    kinds = T.StructType([queries.schema["_s"], T.StructField("list", T.IntegerType()), T.StructField("n", T.LongType())])
    return queries.mapInArrow(count, kinds).groupBy("_s", "list").agg(F.sum("n").alias("n"))


def _first_lists(units: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes]


def short_lists(queries: DataFrame, index: VectorIndex, short: int, query_key: str = "query_id", vector: str = "embedding",
                probes: int | None = None, block_rows: int = vec.BLOCK_ROWS) -> DataFrame:
    """``(_s, _q, list, _id, _c)``: the best rows of each query by their codes, and the vectors' scope and list.

    Codes are small, so a task holds a tile of them with rows of all lists, and a tile of queries: a query moves once for each
    tile and not for each list it goes through, and a tile hands on ``short`` rows per query at most.
    """
    asked = vec._prepare(queries.where(F.size(vector) == index.dim), list(index.scope), query_key, vector)
    left = vec._tiles(asked, block_rows, 4)
    right = index.coded.select("_s", "list", "_id", "code")
    rows = max(block_rows, vec.TILE_VALUES // index.dim)
    counts = right.groupBy("_s").agg(F.ceil(F.count("*") / rows).cast("int").alias("_n"))
    right = right.join(counts, "_s").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    sizes = [side.select("_s", F.col("_n").alias("_m")).distinct() for side in (right, left)]
    left = left.join(sizes[0], "_s").select(
        "_s", F.col("_b").alias("_lb"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_rb"), "_id", "_v")
    right = right.join(sizes[1], "_s").select(
        "_s", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_lb"), F.col("_b").alias("_rb"), "list", "_id", "code")
    centroids, values, dim = index.centroids, index.values, index.dim
    lists = probes or index.probes

    def score(key, a: pa.Table, b: pa.Table) -> pa.Table:
        q_at, c_at, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        number = b["list"].to_numpy() if b.num_rows else np.zeros(0, np.int32)
        if a.num_rows and b.num_rows:
            units = _unit(vec._matrix(a["_v"]))
            codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
            ids = vec._ids(b["_id"])
            found = [_short_of_tile(units[at:at + block_rows], centroids, values, lists, number, codes, ids, short, block_rows, at)
                     for at in range(0, len(units), block_rows)]
            q_at, c_at, value = (np.concatenate(parts) for parts in zip(*found))
        return pa.table({"_s": pa.array([key[0].as_py()] * len(value), pa.string()), "_q": a["_id"].take(pa.array(q_at)),
                         "list": pa.array(number[c_at], pa.int32()), "_id": b["_id"].take(pa.array(c_at)),
                         "_c": pa.array(value, pa.float64())})

    group = ["_s", "_lb", "_rb"]
    out = T.StructType([asked.schema["_s"], T.StructField("_q", asked.schema["_id"].dataType),
                        T.StructField("list", T.IntegerType()), index.coded.schema["_id"], T.StructField("_c", T.DoubleType())])
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, out)
    return top_k(found, ["_q"], [F.desc("_c"), F.asc("_id")], short)


def _short_of_tile(units, centroids, values, probes: int, number, codes, ids, short: int, rows: int, start: int):
    """Row numbers of queries and codes, and scores, of the ``short`` best codes of each query in its lists of a tile."""
    probed = np.zeros((len(units), len(centroids)), bool)
    np.put_along_axis(probed, _first_lists(units, centroids, probes), True, axis=1)
    order = np.argsort(number, kind="stable")
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    waiting, floor = 0, np.full(len(units), -np.inf)

    def settle():
        nonlocal waiting
        _, _, place = _best_places(*held, ids, short)
        held[:] = held[0][place], held[1][place], held[2][place]
        waiting = 0
        full = np.bincount(held[0], minlength=len(units)) >= short
        last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True]) if len(held[0]) else np.zeros(0, int)
        lowest = np.full(len(units), -np.inf)
        lowest[held[0][last]] = held[2][last]
        floor[:] = np.where(full, lowest, -np.inf)

    for one, begin, end in zip(*_runs(number[order])):
        who = np.flatnonzero(probed[:, one])
        for at in range(begin, end, rows) if len(who) else ():
            members = order[at:min(at + rows, end)]
            scores = units[who] @ (centroids[one] + _decode(codes[members], values, units.shape[1])).T
            some = scores >= floor[who][:, None]
            if some.sum() > 4 * short * len(who):
                # too many, as at the start: only each query's best of these members
                mine, of = vec._candidates(scores, short)
                keep = some[mine, of]
                mine, of = mine[keep], of[keep]
            else:
                mine, of = np.nonzero(some)
            held[:] = np.r_[held[0], who[mine]], np.r_[held[1], members[of]], np.r_[held[2], scores[mine, of]]
            waiting += len(mine)
            if waiting > 2 * short * len(units):
                settle()
    settle()
    return held[0] + start, held[1], held[2]


def _runs(sorted_values: np.ndarray):
    """Values, starts and ends of the runs of a sorted array."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[starts], starts, np.r_[starts[1:], len(sorted_values)]


def _best_places(owner: np.ndarray, at: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int):
    """Owners, values and places of the first k entries per owner by falling value, then by id."""
    order = np.lexsort((ids[at], -value, owner))
    starts = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]]) if len(owner) else np.zeros(0, int)
    nth = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    place = order[nth < k]
    return owner[place], value[place], place


def search(queries: DataFrame, index: VectorIndex, k: int, *, short: int = 40, query_key: str = "query_id",
           vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """Approximate k nearest by cosine: ``(query_key, key, similarity, rank)``; similarities are exact."""
    return _exact(queries, short_lists(queries, index, short, query_key, vector, probes), index, k, query_key, vector)


def _exact(queries: DataFrame, listed: DataFrame, index: VectorIndex, k: int, query_key: str, vector: str) -> DataFrame:
    """The k best rows of short lists by their exact scores."""
    listed = listed.select("_s", "_q", "list", "_id")
    asked = queries.select(F.col(query_key).alias("_q"), F.col(vector).cast("array<double>").alias("_w"))
    held = index.coded.select("_s", "list", "_id", "_v")
    scored = listed.join(held, ["_s", "list", "_id"]).join(asked, "_q").select(
        "_q", "_id", F.round(vx.cosine(F.col("_w"), F.col("_v")), vec.DIGITS).alias("similarity"))
    best = top_k(scored, ["_q"], [F.desc("similarity"), F.asc("_id")], k)
    return best.select(F.col("_q").alias(query_key), F.col("_id").alias(index.key), "similarity", "rank")


def recall_report(queries: DataFrame, corpus: DataFrame, index: VectorIndex, k: int, *, short: int = 40,
                  query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """One row: queries, exact neighbours, how many of them the index finds, and the shares of (query, row) pairs of a scope
    that were scored by their codes and exactly."""
    exact = cut_lineage(vec.nearest(queries, corpus, k, scope=list(index.scope) or None, query_key=query_key,
                                    corpus_key=index.key, vector=vector))
    compared = cut_lineage(short_lists(queries, index, short, query_key, vector).select("_s", "_q", "list", "_id"))
    found = _exact(queries, compared, index, k, query_key, vector)
    hits = exact.join(found.select(query_key, index.key), [query_key, index.key], "left_semi").agg(F.count("*").alias("found"))
    asked = vec._prepare(queries.where(F.size(vector) == index.dim), list(index.scope), query_key, vector)
    rows = index.coded.groupBy("_s", "list").agg(F.count("*").alias("rows"))
    all_pairs = asked.groupBy("_s").agg(F.count("*").alias("n")).join(rows.groupBy("_s").agg(F.sum("rows").alias("rows")), "_s")
    by_code = _probes_by_list(asked, index).join(rows, ["_s", "list"])
    total, coded = (df.agg(F.sum(F.col("n") * F.col("rows")).alias(name)) for df, name in ((all_pairs, "pairs"), (by_code, "coded")))
    parts = [exact.agg(F.countDistinct(query_key).alias("queries"), F.count("*").alias("neighbours"),
                       F.round(F.sum("similarity"), 3).alias("similarity")), hits, total, coded,
             compared.agg(F.count("*").alias("exact"))]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part, allowMissingColumns=True)
    joined = joined.agg(*[F.max(c).alias(c) for c in joined.columns])
    return joined.select("queries", "neighbours", "similarity", (F.col("found") / F.col("neighbours")).alias("recall"),
                         (F.col("coded") / F.col("pairs")).alias("share_by_code"),
                         (F.col("exact") / F.col("pairs")).alias("share_exact"))
