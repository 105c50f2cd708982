"""Token counts by rank-synchronous array merging (byte-level BPE).

A text is cut before blanks, where no pre-token can span, and each different piece is counted once per worker. The
pre-tokens of all new pieces of a batch lie end to end in one symbol array. Each round looks up the rank of every
neighbouring pair, finds the lowest rank of each sequence, merges all its places at once (of overlapping ones every
second, from the left), and retires sequences without a pair. The symbols that survive are the tokens.

Null texts count as empty. A special token's string inside a text is one token, as the tokenizer's default has it.
Repeated rows, ties and extra columns are kept as they are: only the id and the text are read, one row is returned for
each row. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ragspark.llm.common import slices

#: The pre-token pattern and the limit on remembered pieces.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 600_000
LONG_BYTES = 2048
EARLY = 2048
BATCH_ROWS = 256
_SPACE_RUN = re.compile(r"\s\s")
_PIECES = re.compile(r"\s*\S+|\s+")
_NONE = np.int64(1 << 40)


class RankMerger:
    """The merge table of a tokenizer file and the array form of its merging."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        # printable bytes stand for themselves, the others for the code points from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        of_char = {c: b for b, c in shown.items()}
        listed = sorted((i, t) for t, i in vocab.items() if t not in self.special)
        self.token_bytes = [bytes(map(of_char.__getitem__, t)) for _, t in listed]
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # pairs of early tokens, by far the most frequent, have a direct table
        left, right = np.divmod(self.keys, self.size)
        early = np.flatnonzero((left < EARLY) & (right < EARLY))
        self.direct = np.full(EARLY * EARLY, -1, np.int32)
        self.direct[left[early] * EARLY + right[early]] = early
        self.pattern = regex.compile(PRE_TOKEN)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        early = (left < EARLY) & (right < EARLY)
        at = np.where(early, self.direct[np.where(early, left * EARLY + right, 0)], -1).astype(np.int64)
        late = np.flatnonzero(~early)
        key = left[late] * self.size + right[late]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at[late] = np.where(self.keys[found] == key, found, -1)
        return np.where(at < 0, _NONE, self.ranks[at]), at

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all sequences end to end, and their number in each sequence."""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbols = self.byte_ids[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        long = np.flatnonzero(lengths > LONG_BYTES)
        done = [(np.full(len(t), i), t) for i in long for t in [self.merge_long(symbols[owner == i])]]
        if len(long):
            keep = (lengths <= LONG_BYTES)[owner]
            symbols, owner = symbols[keep], owner[keep]
        while len(symbols):
            ranks, at = self._looked_up(symbols[:-1], symbols[1:])
            ranks[owner[1:] != owner[:-1]] = _NONE
            ranks = np.append(ranks, _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(owner))))
            over = lowest == _NONE
            if over.any():
                done.append((owner[over], symbols[over]))
            chosen = np.flatnonzero((ranks == lowest) & ~over)
            if not len(chosen):
                break
            # neighbours in a row overlap: keep every second one from the left of each such run
            heads = np.flatnonzero(np.append(True, np.diff(chosen) != 1))
            place = np.arange(len(chosen)) - np.repeat(heads, np.diff(np.append(heads, len(chosen))))
            chosen = chosen[place % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(sequences), np.int64)
        owner, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(sequences))

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merging of one very long pre-token with a heap, as rounds over it would be as many as its ranks."""
        ids, follow, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        ranks, at = self._looked_up(symbols[:-1], symbols[1:])
        heap = [(int(r), i, int(a), ids[i], ids[i + 1]) for i, (r, a) in enumerate(zip(ranks, at)) if r < _NONE]
        heapq.heapify(heap)
        alive = [True] * len(ids)

        def push(i: int, j: int) -> None:
            r, a = self._looked_up(np.array([ids[i]]), np.array([ids[j]]))
            if r[0] < _NONE:
                heapq.heappush(heap, (int(r[0]), i, int(a[0]), ids[i], ids[j]))

        while heap:
            _, i, a, left, right = heapq.heappop(heap)
            j = follow[i] if alive[i] else len(ids)
            if j >= len(ids) or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], follow[i] = int(self.made[a]), False, follow[j]
            if follow[i] < len(ids):
                before[follow[i]] = i
                push(i, follow[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([t for t, a in zip(ids, alive) if a], dtype=np.int64)

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces end to end, and their number in each piece; equal pre-tokens are merged once."""
        found = [self.pattern.findall(p) for p in pieces]
        different = {t: i for i, t in enumerate(dict.fromkeys(t for f in found for t in f))}
        ids, counts = self.merge([t.encode("utf-8", "replace") for t in different])
        at = np.fromiter((different[t] for f in found for t in f), dtype=np.int64)
        starts, size = (np.cumsum(counts) - counts)[at], counts[at]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - size), size)
        in_piece = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = np.append(0, ends)[np.append(0, np.cumsum(in_piece))]
        return ids[flat], np.diff(total)


class Pieces:
    """Texts cut into pieces with independent tokens, and what is remembered of each piece."""

    def __init__(self, path: str, keep_ids: bool):
        self.merger = RankMerger(path)
        self.keep_ids = keep_ids
        self.dtype = np.dtype("<u2" if self.merger.size <= 1 << 16 else "<u4")
        self.known: dict = {}
        self.known_heads: dict = {}

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """Pieces that stand alone, and pieces that follow one blank each."""
        if _SPACE_RUN.search(text):
            return _PIECES.findall(text), []
        head, *rest = text.split(" ")
        return ([head] if head else []), rest

    def _learn(self, known: dict, pieces: list[str], prefix: str) -> None:
        ids, counts = self.merger.of_pieces([prefix + p for p in pieces])
        if self.keep_ids:
            raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            ends = (np.cumsum(counts) * width).tolist()
            known.update(zip(pieces, (raw[a:b] for a, b in zip([0, *ends], ends))))
        else:
            known.update(zip(pieces, counts.tolist()))

    def of(self, texts: list[str]) -> list:
        """The token count of each text, or its ids as bytes."""
        if len(self.known) + len(self.known_heads) > REMEMBERED:
            self.known, self.known_heads = {}, {}
        cuts, special = [], []
        for text in texts:
            parts = self.merger.specials.split(text) if self.merger.specials else [text]
            cuts.append([self._cut(p) for p in parts[::2]])
            special.append([self.merger.special[p] for p in parts[1::2]])
        for known, k, prefix in ((self.known_heads, 0, ""), (self.known, 1, " ")):
            new = list({p for doc in cuts for part in doc for p in part[k]}.difference(known))
            if new:
                self._learn(known, new, prefix)
        out = []
        head, rest = self.known_heads.__getitem__, self.known.__getitem__
        for doc, inside in zip(cuts, special):
            if not self.keep_ids:
                out.append(len(inside) + sum(sum(map(head, a)) + sum(map(rest, b)) for a, b in doc))
                continue
            joined = [b"".join(map(head, a)) + b"".join(map(rest, b)) for a, b in doc]
            for i, token in enumerate(inside):
                joined[i] += np.array([token], self.dtype).tobytes()
            out.append(b"".join(joined))
        return out


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, keep_ids: bool) -> Pieces:
    """The worker's own instance; it outlives a task, so later tasks know the pieces of earlier ones."""
    key = (path, keep_ids)
    if key not in _LOADED:
        _LOADED[key] = Pieces(path, keep_ids)
    return _LOADED[key]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pieces(tokenizer, False)
        for batch in slices(batches, BATCH_ROWS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = pa.array(counter.of(texts), pa.int64())
            sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            over = pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, over],
                                             [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
