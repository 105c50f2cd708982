"""BM25 over whitespace tokens, case kept.

The index is three things: postings (one row per document and term), terms (document frequency and idf) and three
corpus numbers. Postings are counted inside the document's row, so building them shuffles nothing.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.operators.embedding import _slices
from ragspark.operators.ranking import top_k
from ragspark.session import cut_lineage

DIGITS = 9
BLOCK_DOCUMENTS = 10_000
BLOCK_QUERIES = 500
#: Sums of (query, document) that one task holds at most, on average; all queries may share a term with all documents.
SUMS_PER_TASK = 250_000
#: Weights of query terms that are sent to every task at most; a join with more moves the sums, not the postings alone.
SENT_ROWS = 500_000


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # doc_id, doc_len, term, tf
    terms: DataFrame  # term, df, idf
    documents: int
    mean_length: float
    mean_idf: float


def _term_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct words of each text with their counts and the number of all words, a few texts at a time.

    ``str.split`` without a separator cuts at the characters of ``tx.SPACE``.
    """
    for texts in batches:
        found = [pa.array([], _COUNTS)]
        for some in _slices(texts):
            counts = [Counter(t.split()) if t else Counter() for t in some]
            sizes = np.array([len(c) for c in counts])
            each = pa.StructArray.from_arrays([
                pa.array(itertools.chain.from_iterable(counts), pa.string()),
                pa.array(itertools.chain.from_iterable(c.values() for c in counts), pa.int32()),
                pa.array(np.repeat([c.total() for c in counts], sizes).astype("int32"), pa.int32())], ["term", "tf", "doc_len"])
            found.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), each))
        yield pa.concat_arrays(found)


_COUNTS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("doc_len", pa.int32())]))
_term_counts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    counts = F.arrow_udf(_term_counts, "array<struct<term: string, tf: int, doc_len: int>>").asNondeterministic()
    counted = docs.select(F.col(key), counts(F.col(text)).alias("_t"))
    return counted.select(key, F.explode_outer("_t").alias("_p")).where("_p is not null").select(
        key, F.col("_p.doc_len").alias("doc_len"), F.col("_p.term").alias("term"), F.col("_p.tf").alias("tf"))


def term_statistics(posted: DataFrame, documents: int) -> DataFrame:
    """Document frequency and raw idf per term; counts are combined in each task before the shuffle."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(float(documents))
    return df.withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))


def corpus_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return docs.agg(F.count("*").alias("documents"), F.avg(tx.word_count(F.col(text))).alias("mean_length"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Bm25Index:
    """Index of a corpus. The texts are read once, to write the postings; the rest comes from those.

    Postings and terms lie in the shared checkpoint folder. Three numbers come back to the driver.
    """
    posted = cut_lineage(postings(docs, key, text))
    n = docs.count()
    terms = cut_lineage(term_statistics(posted, n))
    length, mean_idf = posted.agg(F.sum("tf")).first()[0] or 0, terms.agg(F.avg("idf")).first()[0] or 0.0
    return Bm25Index(posted, terms, n, length / n if n else 0.0, mean_idf)


def floored_idf(index: Bm25Index) -> Column:
    """Terms of more than half the documents have a negative idf; they get a share of the mean instead."""
    return F.when(F.col("idf") < 0, F.lit(fv.BM25_IDF_FLOOR * index.mean_idf)).otherwise(F.col("idf"))


def scores(queries: DataFrame, index: Bm25Index, key: str = "doc_id", query: str = "query") -> DataFrame:
    """``(query_id, key, score)`` of every document that holds a term of the query.

    Only postings of query terms move, and they move by document: a document's partial scores then meet without a
    second shuffle. Each posting becomes a row for every query with its term, so the number of tasks follows the number
    of possible sums and not the bytes of the postings, which say little about it.
    """
    sums = index.documents * queries.select("query_id").count()
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-sums // SUMS_PER_TASK))
    weights = cut_lineage(
        queries.select("query_id", F.explode(tx.words(F.col(query))).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        .join(index.terms, "term")
        .select("query_id", "term", (F.col("qtf") * floored_idf(index)).alias("weight"))
    )
    if weights.count() <= SENT_ROWS:
        weights = F.broadcast(weights)
    found = index.postings.join(weights.select("term").distinct(), "term", "left_semi").repartition(tasks, key)
    length_part = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * F.col("doc_len") / F.lit(index.mean_length))
    part = F.col("weight") * F.col("tf") * (fv.BM25_K1 + 1) / (F.col("tf") + length_part)
    return found.join(weights, "term").groupBy("query_id", key).agg(F.round(F.sum(part), DIGITS).alias("score"))


def search(queries: DataFrame, index: Bm25Index, k: int, key: str = "doc_id", query: str = "query") -> DataFrame:
    """Documents with the k best scores per query: ``(query_id, key, score, rank)``; each task hands on k at most."""
    found = scores(queries, index, key, query)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc(key)], k).select("query_id", key, "score", "rank")


def search_filled(
    queries: DataFrame, docs: DataFrame, index: Bm25Index, k: int, key: str = "doc_id", query: str = "query"
) -> DataFrame:
    """As ``search`` over all documents: those without a query term score 0 and follow in key order.

    Scores of matched documents can be positive, 0 (a term of exactly half the corpus) or negative (a floored idf below
    0), and ties go by key, so a query with fewer than k positive scores ranks its matches together with documents it
    does not match. Those are found in blocks of documents and queries; each block hands on k per query at most.
    """
    hits = cut_lineage(search(queries, index, k, key, query))
    positive = hits.groupBy("query_id").agg(F.count(F.when(F.col("score") > 0, 1)).alias("n"))
    short = cut_lineage(queries.join(positive, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
                        .select("query_id", F.col(query).alias("query")))
    both = hits.select("query_id", key, "score").unionByName(
        _unmatched(short, docs, index, k, key).select("query_id", key, F.lit(0.0).alias("score")))
    return top_k(both, ["query_id"], [F.desc("score"), F.asc(key)], k).select("query_id", key, "score", "rank")


def _unmatched(asked: DataFrame, docs: DataFrame, index: Bm25Index, k: int, key: str) -> DataFrame:
    """Per query and document block the first k documents without a term of the query."""
    doc_blocks = max(1, -(-index.documents // BLOCK_DOCUMENTS))
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    every = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (doc_blocks, query_blocks))
    in_docs, in_queries = F.pmod(F.xxhash64(key), F.lit(doc_blocks)).cast("int"), F.pmod(
        F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    terms = asked.select("query_id", F.explode(tx.words(F.col("query"))).alias("term")).distinct()
    pairs = index.postings.join(terms, "term").select("query_id", key).distinct()
    none = F.lit(None)
    listed = asked.select("query_id", next(every).alias("db"), in_queries.alias("qb"), F.lit(0).alias("kind"),
                          none.cast(docs.schema[key].dataType).alias(key))
    stock = docs.select(none.cast(asked.schema["query_id"].dataType).alias("query_id"), in_docs.alias("db"),
                        next(every).alias("qb"), F.lit(1).alias("kind"), key)
    met = pairs.select("query_id", in_docs.alias("db"), in_queries.alias("qb"), F.lit(2).alias("kind"), key)

    def first(rows: pa.Table) -> pa.Table:
        names, keys, kinds = (rows[c].to_pylist() for c in ("query_id", key, "kind"))
        stocked = sorted(d for d, kind in zip(keys, kinds) if kind == 1)
        matched: dict = {}
        for q, d, kind in zip(names, keys, kinds):
            if kind == 2:
                matched.setdefault(q, set()).add(d)
        found: list[tuple] = []
        for q in (q for q, kind in zip(names, kinds) if kind == 0):
            free = (d for d in stocked if d not in matched.get(q, ()))
            found += [(q, d) for d in itertools.islice(free, k)]
        return pa.Table.from_arrays([pa.array([q for q, _ in found], rows.schema.field("query_id").type),
                                     pa.array([d for _, d in found], rows.schema.field(key).type)], ["query_id", key])

    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{key}` {docs.schema[key].dataType.simpleString()}"
    return listed.unionByName(stock).unionByName(met).groupBy("db", "qb").applyInArrow(first, kind)
