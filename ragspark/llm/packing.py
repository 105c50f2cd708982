"""Packing of token sequences by concatenating and cutting.

First pass: every document becomes its token ids and an end id, stored with its place inside its partition. The
partitions' token totals (one row each) give each partition its global start by a prefix sum. Second pass: the stream
of all tokens is cut at multiples of the sequence length; each document yields its pieces between the cuts. No row is
shuffled. Only the last sequence can be short.

Null and empty texts consist of the end id alone. Repeated rows are packed as often as they occur; of extra columns
only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import slices, stored
from ragspark.llm.token_counts import BATCH_ROWS, PRE_TOKEN, RankMerger, pieces

PIECE = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "sequence_tokens long, padding long")

#: Runs this long go to the array merging, as a regular expression engine may exhaust its stack on them.
_LONG = 20_000
_LONG_RUN = re.compile(r"\S{20000}|\s{20000}")
#: Latin-1 bytes whose character classes no Unicode version or library disputes.
_SETTLED = bytes([9, 10, 13, *range(32, 127), *range(161, 173), *range(174, 256)])


def _settled(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _SETTLED)
    except UnicodeEncodeError:
        return False


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file, its special strings included."""

    def __init__(self, path: str):
        import tiktoken
        merger = RankMerger(path)
        ranks = {merger.token_bytes[i]: i for i in range(len(merger.token_bytes))}
        self.path = path
        self.dtype = np.dtype("<u2" if merger.size <= 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks,
                                          special_tokens=merger.special)

    def of(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if not _settled(text) or len(text) >= _LONG and _LONG_RUN.search(text):
            return np.frombuffer(pieces(self.path, True).of([text])[0], dtype=self.dtype)
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_stream(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A stored table of ``part``, ``at`` (tokens before, in the part), the id, ``n_tokens`` and ``ids`` (16 or 32 bits each)."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], known.dtype).tobytes()
        for batch in slices(batches, BATCH_ROWS):
            ids = [known.of(t).tobytes() + end for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) // known.dtype.itemsize for x in ids], dtype=np.int64)
            places = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(places), batch.column(0), pa.array(counts),
                 pa.array(ids, pa.binary())], ["part", "at", id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return stored(docs.select(id_col, text_col).mapInArrow(
        tokenised, f"part int, at long, `{id_col}` {kind}, n_tokens long, ids binary"))


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts in the document, its length, the CRC-32 of its ids as
    unsigned 32-bit numbers, the document's tokens, and its sequence and offset there.

    ``sequence_tokens`` and ``padding`` are those of the piece's sequence.
    """
    stream = token_stream(docs, tokenizer, end_id, id_col, text_col)
    # one row for each written partition, so both the ordered sum and the broadcast are small
    totals = stream.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first()["total"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            columns: list[list] = [[] for _ in range(9)]
            for key, begin, raw, count in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype=f"<u{len(raw) // count}").astype("<u4")
                edges = [0, *range(length - begin % length, count, length), count]
                for start, stop in zip(edges, edges[1:]):
                    sequence, offset = divmod(begin + start, length)
                    filled = min(length, total - sequence * length)
                    row = (key, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), count, sequence, offset,
                           filled, length - filled)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                 "padding"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = stream.join(F.broadcast(bases), "part").select(id_col, (F.col("base") + F.col("at")).alias("begin"), "ids",
                                                            "n_tokens")
    return placed.mapInArrow(cut, f"`{id_col}` {kind}, {PIECE}")
