"""Embedders and scorers. Both are plain functions, so a model of the caller's choice takes the place of ours.

An embedder is ``(df, text_column, out_column) -> DataFrame``; queries and corpus must use the same one. A scorer is
``(query_column, text_column) -> Column``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions import text as tx

Embedder = Callable[[DataFrame, str, str], DataFrame]
Scorer = Callable[[Column, Column], Column]

_VECTOR = T.ArrayType(T.FloatType())
#: What an encoder cuts into words at a time, and the words whose slots it remembers.
SLICE_TEXTS = 256
SLICE_CHARS = 1_000_000
KNOWN_WORDS = 200_000


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, few at a time, however many or long they are."""
    for start in range(0, len(texts), SLICE_TEXTS):
        part, chars = [], 0
        for text in texts.slice(start, SLICE_TEXTS).to_pylist():
            part.append(text)
            chars += len(text or "")
            if chars > SLICE_CHARS:
                yield part
                part, chars = [], 0
        if part:
            yield part


class _Slots(dict):
    """The slot of each word, hashed when the word is first met."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        slot = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return slot


def hashing_embedder(dim: int = 64) -> Embedder:
    """Lower-cased words counted in ``dim`` hashed slots, scaled to unit length. Needs no model and no fitting."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots, words = _Slots(dim), re.compile(r"\w+").findall
        for texts in batches:
            vectors = np.zeros((len(texts), dim), "float32")
            at = 0
            for some in _slices(texts):
                counts = np.zeros((len(some), dim))
                for row, text in enumerate(some):
                    found = words(text.lower()) if text else []
                    counts[row] = np.bincount(np.fromiter(map(slots.__getitem__, found), np.int64, len(found)), minlength=dim)
                lengths = np.linalg.norm(counts, axis=1, keepdims=True)
                vectors[at:at + len(some)] = counts / np.where(lengths == 0, 1, lengths)
                at += len(some)
                if len(slots) > KNOWN_WORDS:
                    slots.clear()
            ends = pa.array(np.arange(0, vectors.size + 1, dim, dtype="int32"))
            yield pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    once = F.arrow_udf(encode, _VECTOR).asNondeterministic()

    def embed(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return df.withColumn(out, once(F.col(text)))

    return embed


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Embedder:
    """An embedder for a model: ``load`` runs once per Python worker and returns ``texts -> matrix``."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch):
                rows.extend(np.asarray(model(list(texts[start:start + batch])), dtype="float32"))
            yield pd.Series(rows)

    def embed(df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return df.withColumn(out, _once(encode)(tx.collapse_whitespace(F.col(text))))

    return embed


def precomputed(column: str) -> Embedder:
    """Vectors that are already in the table."""
    return lambda df, text, out="embedding": df.withColumn(out, F.col(column).cast(_VECTOR))


def _once(encode):
    """The encoder as an Arrow UDF that Spark does not copy into filters on its result and so runs once per row."""
    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, _VECTOR).asNondeterministic()


def lexical_scorer(query: Column, text: Column) -> Column:
    """Saturating term counts of the query's keywords in the text, 0 to 2.5 per keyword."""
    def score(ts: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            count = F.size(ts) - F.size(F.array_remove(ts, k))
            return total + tx.let(count, lambda n: n * 2.5 / (n + 1.5))
        return F.aggregate(tx.query_keywords(query), F.lit(0.0), add)
    return tx.let(tx.tokens(text), score)
