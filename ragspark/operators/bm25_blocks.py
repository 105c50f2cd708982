"""BM25 top-k that stops early: postings in blocks of neighbouring documents, with the most a term can give in each block.

A block's bound for a query is the sum of its terms' weights times their largest impact in the block. Bounds are narrow rows, one
for each query and block, whatever the number of documents. A query first scores its most promising blocks; the k-th best
score found there is its threshold, and of the other blocks only those whose bound reaches it are scored. Inside a block
terms are ordered by their bounds: those that cannot reach the threshold together are not essential, so only documents
of the essential ones are candidates, and the others are added to these. A block hands on k rows per query at most.

Rows are those of ``bm25.search``. A block holds a bounded number of postings and meets bounded numbers of queries at a
time, so hot terms and many queries become more groups, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.operators import bm25
from ragspark.operators.ranking import top_k
from ragspark.session import cut_lineage

BLOCK_POSTINGS = 500_000
FIRST_BLOCKS = 2
BLOCK_QUERIES = 500
#: What rounding may add to a score that its bound does not know of.
SLACK = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    """``lists`` is ``(block, term, upper, postings)``: postings are the block's documents with the term and its impact."""

    lists: DataFrame
    base: bm25.Bm25Index
    key: str


def block_index(index: bm25.Bm25Index, key: str = "doc_id", block_postings: int = BLOCK_POSTINGS) -> BlockIndex:
    """The postings of an index in blocks, cut along the order of the keys at about ``block_postings`` each."""
    length_part = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * F.col("doc_len") / F.lit(index.mean_length))
    impact = F.col("tf") * (fv.BM25_K1 + 1) / (F.col("tf") + length_part)
    blocks = max(1, -(-index.postings.count() // block_postings))
    placed = index.postings.select(F.col(key).alias("doc"), "term", impact.alias("impact")).repartitionByRange(blocks, "doc")
    doc, key_kind = placed.schema["doc"].dataType, placed.schema["doc"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema).combine_chunks()
        if rows.num_rows:
            docs, terms, impacts = (c.combine_chunks() for c in rows.columns)
            codes = terms.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = pa.array(np.r_[starts, len(codes)].astype(np.int32))
            most = np.maximum.reduceat(impacts.to_numpy(), starts)
            items = pa.StructArray.from_arrays([docs, impacts], ["doc", "impact"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), TaskContext.get().partitionId(), np.int32)), terms.take(pa.array(starts)),
                 pa.array(most), pa.ListArray.from_arrays(ends, items)], ["block", "term", "upper", "postings"])

    schema = pa.schema([("doc", to_arrow_type(doc)), ("term", pa.string()), ("impact", pa.float64())])
    # all rows of a block lie in one partition, so its lists are made there and the postings move once
    lists = placed.sortWithinPartitions("term").mapInArrow(
        listed, f"block int, term string, upper double, postings array<struct<doc: {key_kind}, impact: double>>")
    return BlockIndex(cut_lineage(lists), index, key)


def _weights(queries: DataFrame, index: bm25.Bm25Index, query: str) -> DataFrame:
    asked = queries.select("query_id", F.explode(tx.words(F.col(query))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf"))
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * bm25.floored_idf(index)).alias("weight"))


def _bounds(weights: DataFrame, index: BlockIndex) -> DataFrame:
    """The most a document of a block can score, for each query and block with one of its terms."""
    uppers = index.lists.select("block", "term", "upper")
    most = F.greatest(F.col("weight") * F.col("upper"), F.lit(0.0))
    return uppers.join(weights, "term").groupBy("query_id", "block").agg(F.sum(most).alias("bound"))


def _scored(pairs: DataFrame, weights: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """``(query_id, doc, score)``: of each ``(query_id, block, least)`` the k best documents not below ``least``."""
    chunks = max(1, -(-weights.select("query_id").distinct().count() // BLOCK_QUERIES))
    asked = pairs.join(weights, "query_id").select(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"), "query_id", "least", "term", "weight")
    wanted = asked.select("block", "chunk", "term").distinct()
    # the stored terms tell Spark how few they are, so lists of other terms are left out where they lie
    terms = cut_lineage(weights.select("term").distinct())
    held = wanted.join(index.lists.join(terms, "term", "left_semi"), ["block", "term"])
    # columns of their own, as both sides of the cogroup come from ``asked``
    held = held.select(*[F.col(c).alias(c) for c in ("block", "chunk", "term", "upper", "postings")])

    def score(queries: pa.Table, lists: pa.Table) -> pa.Table:
        terms = lists["term"].to_pylist()
        postings = lists["postings"].combine_chunks()
        sizes = np.diff(postings.offsets.to_numpy()) if len(postings) else np.zeros(0, np.int64)
        flat = postings.flatten() if len(postings) else None
        docs, places = (np.unique(np.asarray(flat.field("doc").to_pylist()), return_inverse=True) if flat is not None
                        else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        impacts = flat.field("impact").to_numpy(zero_copy_only=False) if flat is not None else np.zeros(0)
        ends = np.cumsum(sizes)
        uppers = lists["upper"].to_pylist()
        of_term = {t: (u, places[e - n:e], impacts[e - n:e]) for t, u, n, e in zip(terms, uppers, sizes, ends)}
        by_query: dict = {}
        for q, least, term, weight in zip(*(queries[c].to_pylist() for c in ("query_id", "least", "term", "weight"))):
            if term in of_term:
                by_query.setdefault(q, (least, []))[1].append((weight, *of_term[term]))
        names, found, values = [], [], []
        for q, (least, parts) in by_query.items():
            at, score_of = best_of_block(parts, len(docs), k, least)
            names += [q] * len(at)
            found.append(docs[at])
            values.append(score_of)
        keys = np.concatenate(found).tolist() if found else []
        return pa.Table.from_arrays(
            [pa.array(names, queries.schema.field("query_id").type),
             pa.array(keys, lists.schema.field("postings").type.value_type.field("doc").type),
             pa.array(np.concatenate(values) if values else [], pa.float64())], ["query_id", "doc", "score"])

    doc_kind = index.lists.schema["postings"].dataType.elementType["doc"].dataType
    kind = f"query_id {weights.schema['query_id'].dataType.simpleString()}, doc {doc_kind.simpleString()}, score double"
    return asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInArrow(score, kind)


def best_of_block(parts: list[tuple], size: int, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below ``size``) with the k best scores not below ``least``, and the scores.

    ``parts`` are the query's terms in the block: weight, largest impact, documents, impacts.
    """
    parts = sorted(parts, key=lambda p: max(p[0] * p[1], 0.0))
    together = np.cumsum([max(weight * upper, 0.0) for weight, upper, _, _ in parts])
    # terms that stay below the threshold all together cannot bring a document in
    spare = int((together + SLACK < least).sum()) if least is not None and least > 0 else 0
    total, seen = np.zeros(size), np.zeros(size, bool)
    for weight, _, docs, impacts in parts[spare:]:
        total[docs] += weight * impacts
        seen[docs] = True
    for at in range(spare - 1, -1, -1):
        seen &= total + together[at] + SLACK >= least
        weight, _, docs, impacts = parts[at]
        inside = seen[docs]
        total[docs[inside]] += weight * impacts[inside]
    found = np.flatnonzero(seen)
    scores = np.round(total[found], bm25.DIGITS) + 0.0
    if least is not None:
        found, scores = found[scores >= least], scores[scores >= least]
    order = np.lexsort((found, -scores))[:k]
    return found[order], scores[order]


def _rounds(queries: DataFrame, index: BlockIndex, k: int, query: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Weights, the first blocks of each query, their best rows, and the blocks that are left to score."""
    weights = cut_lineage(_weights(queries, index.base, query))
    bounds = cut_lineage(_bounds(weights, index))
    first = cut_lineage(top_k(bounds, ["query_id"], [F.desc("bound"), F.asc("block")], FIRST_BLOCKS).select(
        "query_id", "block", F.lit(None).cast("double").alias("least")))
    found = cut_lineage(_scored(first, weights, index, k))
    ranked = top_k(found, ["query_id"], [F.desc("score"), F.asc("doc")], k)
    least = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    rest = cut_lineage(rest.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select(
        "query_id", "block", "least"))
    return weights, first, found, rest


def search(queries: DataFrame, index: BlockIndex, k: int, query: str = "query") -> DataFrame:
    """Documents with the k best scores per query: ``(query_id, key, score, rank)``, the rows of ``bm25.search``."""
    weights, _, found, rest = _rounds(queries, index, k, query)
    both = found.unionByName(_scored(rest, weights, index, k))
    best = top_k(both, ["query_id"], [F.desc("score"), F.asc("doc")], k)
    return best.select("query_id", F.col("doc").alias(index.key), "score", "rank")


def visited_blocks(queries: DataFrame, index: BlockIndex, k: int, query: str = "query") -> DataFrame:
    """``(query_id, blocks, visited)``: blocks with a term of the query, and how many of them a search scores."""
    weights, first, _, rest = _rounds(queries, index, k, query)
    every = _bounds(weights, index).groupBy("query_id").agg(F.count("*").alias("blocks"))
    seen = first.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("visited"))
    return every.join(seen, "query_id")
