"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.session import cut_lineage

WORD = re.compile("[^\x20\x09-\x0d]+")
#: White space of ``str.split`` that does not end a word here.
_OTHER_SPACES = [chr(c) for c in (*range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)]
_UPPER_ASCII = re.compile("[A-Z]+")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, safe from lost executors."""
    return cut_lineage(df)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shipped(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if its counted size allows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a batch of long texts does not fill a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; ``str.split`` where no other white space occurs, as it is faster."""
    if not text:
        return []
    return WORD.findall(text) if any(c in text for c in _OTHER_SPACES) else text.split()


def lower_ascii(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    if text.isascii():
        return text.lower()
    return _UPPER_ASCII.sub(lambda m: m[0].lower(), text)


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of different words."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` consecutive word hashes, by doubling the covered length."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor, part, span, out, covered = np.uint64(factor), words, 1, None, 0
    left = size
    while left:
        if left & 1:
            out = part[:n] if out is None else mixed(out * factor + part[covered:covered + n])
            covered += span
        left >>= 1
        if left:
            part = mixed(part[:-span] * factor + part[span:] + np.uint64(span))
            span *= 2
    return mixed(out ^ np.uint64(size))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def text_key(text: Column) -> Column:
    """A key for equal texts; with the id it names a row up to repeated rows."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
