"""Benchmark decontamination: BM25 retrieval of test items for every training passage, then a check of both parts.

The test items are the indexed side. Their inverted index holds, for every term, postings sorted by item with the BM25
weight as a share of the item's own score, and the largest weight of every block of items (block-max). Passages are
overlapping windows of the whole text, long enough that any item lies whole in one. A task scores a batch of passages
term by term: (1) the terms' global maxima bound each passage's score and most passages fall; (2) the block maxima bound
each (passage, block) and most blocks fall; (3) postings of the blocks left give exact scores, and every item at or above
``threshold`` of its own score is retrieved. Nothing is cut off by rank.

A retrieved item counts as leaked when the passage holds at least ``overlap`` of the word pairs of its question (the
first two thirds of its words) and of its answer (the rest).

Items are indexed whole, however long: those of up to ``ITEM_WORDS`` words together, longer ones with others of up to twice
the length, so that passages follow the length of the items they are searched for. Blocks hold ``ITEMS_PER_INDEX`` items at
most, one pass over the passages each; term statistics cover all items. Only an item of one or two words has no answer. Null and empty texts hold no passage and no item. Equal items are found alike,
repeated documents are reported once; documents without an id cannot be named and are left out of the report; extra
columns are not read; an empty table on either side gives an empty result. Ties do not matter, as nothing is ranked.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import slices, words_of

K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
ITEMS_PER_INDEX = 20_000
BATCH_ROWS = 256
ITEM_WORDS = 400
DENSE = 1 << 22
_EDGES = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    """A word in lower case without the marks around it; a word of marks alone stays."""
    bare = word.rstrip(".,;:!?")
    if bare.isalnum():  # by far the most words; the pattern gives the same
        return bare.lower()
    return _EDGES.sub("", word.lower()) or word


class Terms(dict):
    """Term numbers of raw words, -1 for words of no item; remembers a bounded number of raw forms."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = self.vocabulary.get(plain(word), -1)
        return found


def summed(keys: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys below ``size`` and the sum of their values; by a table where it is not much larger than the input."""
    if size <= max(DENSE, 4 * len(keys)):
        sums = np.bincount(keys, values, size)
        found = np.flatnonzero(sums)
        return found, sums[found]
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


def one_of(keys: np.ndarray, wanted: np.ndarray, size: int) -> np.ndarray:
    if size > max(DENSE, 4 * len(keys)):
        return np.isin(keys, wanted)
    flags = np.zeros(size, bool)
    flags[wanted] = True
    return flags[keys]


class BlockMaxIndex:
    """Postings in compressed rows: per term its items with weights, and its blocks with their largest weight."""

    def __init__(self, items: list[tuple[int, list[str]]], weights: dict[str, float], mean_length: float):
        self.items = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, w in items for t in w}))}
        term, item, weight = [], [], []
        for i, (_, words) in enumerate(items):
            counted = Counter(words)
            scores = {t: weights[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_length))
                      for t, n in counted.items()}
            own = sum(scores.values())
            for t, s in scores.items():
                term.append(self.vocabulary[t])
                item.append(i)
                weight.append(s / own)
        order = np.lexsort((item, term))
        self.term, self.item, self.weight = (np.array(x)[order] for x in (term, item, weight))
        self.start = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        block = self.item // BLOCK_ITEMS
        edge = np.flatnonzero(np.r_[True, (self.term[1:] != self.term[:-1]) | (block[1:] != block[:-1])])
        self.block, self.block_max = block[edge], np.maximum.reduceat(self.weight, edge)
        self.block_start = np.searchsorted(self.term[edge], np.arange(len(self.vocabulary) + 1))
        self.top = np.maximum.reduceat(self.weight, self.start[:-1])
        self.longest = max(len(w) for w in self.words)

    @staticmethod
    def _spread(terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the postings of each term, and which entry of ``terms`` each belongs to."""
        size = start[terms + 1] - start[terms]
        owner = np.repeat(np.arange(len(terms)), size)
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[terms], size), owner

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold, from different (passage, term) pairs sorted by passage."""
        if not len(term):
            return []
        slack = threshold - 1e-9
        bound = np.bincount(passage, self.top[term])
        keep = bound[passage] >= slack
        passage, term = passage[keep], term[keep]
        rows, owner = self._spread(term, self.block_start)
        blocks = len(self.items) // BLOCK_ITEMS + 1
        last = int(passage[-1]) + 1 if len(passage) else 0
        cells, sums = summed(passage[owner] * blocks + self.block[rows], self.block_max[rows], last * blocks)
        alive = cells[sums >= slack]
        if not len(alive):
            return []
        keep = one_of(passage, np.unique(alive // blocks), last)
        passage, term = passage[keep], term[keep]
        rows, owner = self._spread(term, self.start)
        keep = one_of(passage[owner] * blocks + self.item[rows] // BLOCK_ITEMS, alive, last * blocks)
        rows, owner = rows[keep], owner[keep]
        hits, score = summed(passage[owner] * len(self.items) + self.item[rows], self.weight[rows], last * len(self.items))
        return [(int(h) // len(self.items), int(h) % len(self.items), float(s))
                for h, s in zip(hits, score) if s >= slack]


def pair_overlap(part: list[str], passage: set[tuple[str, str]], words: set[str]) -> float:
    """Share of the part's neighbouring word pairs that the passage has; of its words where it has one word."""
    if len(part) < 2:
        return float(all(w in words for w in part))
    pairs = set(zip(part, part[1:]))
    return len(pairs & passage) / len(pairs)


def parts_of(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item."""
    cut = max(1, math.ceil(len(words) * 2 / 3))
    return words[:cut], words[cut:]


def length_class(words: int) -> int:
    """0 for items of up to ``ITEM_WORDS`` words, then one more for every doubling."""
    return ((words - 1) // ITEM_WORDS).bit_length()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and leaked item: best score, overlap of question and answer there, and passages that hold it."""
    spark, found = docs.sparkSession, None
    for index in _indexes(spark, benchmark, item_col, item_text_col):
        one = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(
            _search(index, threshold, overlap),
            "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, "
                                          "answer_overlap double")
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"), F.count("*").alias("passages"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6,
                    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; each row is judged by its own text, whatever its id."""
    at = docs.columns.index(text_col)

    def without(index):
        search = _search(index, threshold, overlap)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = Terms(index.value.vocabulary)
            for batch in slices(batches, BATCH_ROWS):
                numbers = pa.array(range(batch.num_rows), pa.int64())
                numbered = pa.RecordBatch.from_arrays([numbers, batch.column(at)], ["row", "text"])
                gone = {n for hits in search(iter([numbered]), terms) for n in hits.column(0).to_pylist()}
                yield batch.filter(pa.array([n not in gone for n in range(batch.num_rows)], pa.bool_())) if gone else batch
        return kept

    for index in _indexes(docs.sparkSession, benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs


def _indexes(spark, benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Broadcast indexes of the items, each of one class of lengths and at most ``ITEMS_PER_INDEX`` items."""
    clean = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("words")).where(
        "item is not null and words is not null")
    blocks = max(1, -(-clean.count() // ITEMS_PER_INDEX))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    by_length: dict[int, list[tuple[int, list[str]]]] = {}
    frequency: Counter = Counter()
    total, length = 0, 0
    for n in range(blocks):
        for row in clean.where(block == n).distinct().orderBy("item", "words").collect():
            words = [plain(w) for w in words_of(row.words)]
            if words:
                by_length.setdefault(length_class(len(words)), []).append((row.item, words))
                frequency.update(set(words))
                length += len(words)
                total += 1
    loaded = [items[a:a + ITEMS_PER_INDEX] for _, items in sorted(by_length.items()) for a in range(0, len(items), ITEMS_PER_INDEX)]
    weights = {t: math.log(1 + (total - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
    for items in loaded:
        yield spark.sparkContext.broadcast(BlockMaxIndex(items, weights, length / total))


def _search(index, threshold: float, overlap: float):
    def search(batches: Iterator[pa.RecordBatch], terms: Terms | None = None) -> Iterator[pa.RecordBatch]:
        held = index.value
        terms = Terms(held.vocabulary) if terms is None else terms
        stride = held.longest
        for batch in slices(batches, BATCH_ROWS):
            keys = batch.column(0).to_pylist()
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            counts = np.array([len(w) for w in texts], dtype=np.int64)
            number = np.fromiter(map(terms.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=counts.sum())
            place = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
            # window k of a document covers its words from k * stride on, two strides long
            windows = np.maximum(1, -(-counts // stride))
            first = np.cumsum(windows) - windows
            owner = np.repeat(np.arange(len(keys)), windows)
            known = number >= 0
            here = np.repeat(first, counts)[known] + place[known] // stride
            pairs = np.concatenate([here, np.where(place[known] >= stride, here - 1, here)])
            size = len(held.vocabulary)
            pairs = np.unique(pairs * size + np.tile(number[known], 2))
            out = []
            for window, item, score in held.retrieve(pairs // size, pairs % size, threshold):
                doc = int(owner[window])
                begin = (window - int(first[doc])) * stride
                words = [plain(w) for w in texts[doc][begin:begin + 2 * stride]]
                have, single = set(zip(words, words[1:])), set(words)
                question, answer = (pair_overlap(p, have, single) for p in parts_of(held.words[item]))
                if question >= overlap and answer >= overlap:
                    out.append((keys[doc], held.items[item], score, question, answer))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
    return search
