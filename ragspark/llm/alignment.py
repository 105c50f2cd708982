"""Alignment of two tokenizers' tokens, and how often each pair of ids ends together, by minimal perfect hashing.

A is a byte-level tokenizer of a ``tokenizers`` file and encodes a blank and the text; B is a ``sentencepiece`` model, which
adds that blank by itself. Both spell the same bytes. Where a token of A and one of B end at the same byte, a group ends, and
the two tokens are linked. No token is without bytes, so a group has exactly one link.

First pass: every task aligns its texts and emits the links' id pairs with their counts. The distinct pairs are given numbers
0..n-1 by a minimal perfect hash. Every task turns its counts into a dense vector of n numbers, and vectors are
added in a tree of at most ``FAN_IN`` children until one is left. Second pass: the texts are aligned again and each link's count
is looked up by hash; the key beside it is compared, so a foreign pair is noticed.

The broadcast is bounded whatever the corpus: of two linked tokens, which end at the same byte of the same text, one ends
with the other's bytes, so their number is at most that of such pairs in the two vocabularies (``most_pairs``, some
hundred thousand for 50,000 and 32,000 tokens).

Texts are cut before blanks between words, where neither tokenizer has a token across, and every different piece is
aligned once per worker. A model with tokens across such blanks gets whole texts. Pieces follow each other, so a text's
groups are those of its pieces.

Null and empty texts, and texts that one of the tokenizers does not spell byte by byte (such as texts with U+2581), have
no tokens: zeros and an empty digest, and no links in the corpus counts. Repeated rows count as often as they occur. Ids of
any type, null included, are handed through; of extra columns only the id and the text are read. Ties of counts are all best.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import mixed, slices, stored
from ragspark.llm.packing import _settled
from ragspark.llm.token_counts import PRE_TOKEN

BATCH_ROWS = 256
#: Pieces and characters a worker remembers.
REMEMBERED = 600_000
REMEMBERED_CHARS = 16 << 20
#: Pieces that are encoded in one call, and children of a node of the sum.
JOINED = 1000
FAN_IN = 16
#: Longer pieces are left to the tokenizer's own library.
PLAIN_CHARS = 2000
#: Places per key in a level of the perfect hash.
GAMMA = 2.0
BLANK = "▁"
_SPACE_RUN = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S)(?= +\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_level_bytes(token: str) -> bytes:
    """The bytes of a byte-level entry: printable bytes stand for themselves, the others for code points from 256 on."""
    return bytes(map(_byte_of().__getitem__, token))


def _byte_of(known: dict[str, int] = {}) -> dict[str, int]:
    if not known:
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        known.update({chr(b): b for b in printable})
        known.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)})
    return known


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentencepiece entry."""
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(BLANK, " ").encode("utf-8")


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.files = byte_file, piece_model
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_model)
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [special[i].encode() if i in special else byte_level_bytes(entries.get(i, ""))
                        for i in range(max(entries) + 1)]
        # the same merges by another library, for characters whose classes no library disputes
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in special}
        self.plain = tiktoken.Encoding("pieces", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(n) for n in names]
        self.can_cut = not any(BLANK in n.lstrip(BLANK) for n in names)

    def __reduce__(self):
        return Tokenizers, self.files  # a pickled tokenizer forgets how it treats special strings

    def most_pairs(self) -> int:
        """Pairs of tokens of which one ends with the other: no other pair can be linked."""
        a, b = Counter(self.a_bytes), Counter(self.b_bytes)
        within = sum(n * b[t[i:]] for t, n in a.items() for i in range(len(t)) if t[i:] in b)
        return within + sum(n * a[t[i:]] for t, n in b.items() for i in range(1, len(t)) if t[i:] in a)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a blank and the text that can be encoded alone, each without the blank it starts with."""
        if not self.can_cut:
            return [text]
        if not (_SPACE_RUN.search(text) or text[0].isspace() or text[-1].isspace()):
            return text.split(" ")
        return [p[1:] for p in _BETWEEN.split(" " + text)]

    def encode(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Ids of A for all pieces end to end, and ids of B for each piece."""
        found = [self.plain.encode_to_numpy(text) for text in self._joined(plain)]
        found += [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(self._joined(others), add_special_tokens=False)]
        return np.concatenate(found).astype(np.int64), self.b.encode(plain + others, num_threads=1)

    @staticmethod
    def _joined(pieces: list[str]) -> list[str]:
        texts, run = [], []
        for piece in pieces:
            run.append(" " + piece)
            # nothing follows white space, as a run of blanks is one pre-token with what is before it
            if len(run) == JOINED or not piece or piece[-1].isspace():
                texts.append("".join(run))
                run = []
        return [*texts, "".join(run)] if run else texts

    def misspelled(self, piece: str, b: list[int]) -> bool:
        """Whether one of the tokenizers spells other bytes than a blank and the piece."""
        spelled = (" " + piece).encode("utf-8", "surrogatepass")
        a = self.a.encode(" " + piece, add_special_tokens=False).ids
        return any(b"".join(map(known.__getitem__, ids)) != spelled for known, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def group_parts(self) -> list[str]:
        """Every id as it stands inside and at the end of its side of a group: of A, then of B."""
        return [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]


def is_plain(piece: str) -> bool:
    return len(piece) < PLAIN_CHARS and (piece.isascii() and piece.isprintable() or _settled(piece))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, with the keys beside their numbers.

    On every level the remaining keys are hashed to ``GAMMA`` places per key; a key that is alone at its place stays there, the
    others go to the next level. A key's number is the count of taken places before its own.
    """

    def __init__(self, keys: np.ndarray):
        left, taken = keys.astype(np.uint64), 0
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        while len(left):
            places = self._places(left, len(self.levels), int(GAMMA * len(left)) + 1)
            alone = np.bincount(places, minlength=int(GAMMA * len(left)) + 1) == 1
            self.levels.append((alone, (np.cumsum(alone) - 1).astype(np.int32), taken))
            taken += int(alone.sum())
            left = left[~alone[places]]
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self._numbers(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mixed(keys ^ seed) % np.uint64(size)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        numbers, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank, before) in enumerate(self.levels):
            places = self._places(keys[open_].astype(np.uint64), level, len(alone))
            hit = alone[places]
            numbers[open_[hit]] = before + rank[places[hit]]
            open_ = open_[~hit]
        return numbers

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for keys that are not among those hashed."""
        keys = np.asarray(keys, np.int64)
        numbers = self._numbers(keys)
        known = numbers >= 0
        known[known] = self.keys[numbers[known]] == keys[known]
        return np.where(known, numbers, -1)


@dataclass
class LinkCounts:
    """How often each pair of ids is linked in the corpus; a pair is ``a * b_size + b``."""

    hashed: PerfectHash
    counts: np.ndarray
    b_size: int

    def __post_init__(self) -> None:
        highest = np.zeros(self.b_size, np.int64)
        np.maximum.at(highest, self.hashed.keys % self.b_size, self.counts)
        self.best = self.counts == highest[self.hashed.keys % self.b_size]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each pair (-1: not counted), and whether it is the highest of its id of B."""
        if not len(self.hashed):
            return np.full(len(pairs), -1), np.zeros(len(pairs), bool)
        numbers = self.hashed.find(pairs)
        return np.where(numbers < 0, -1, self.counts[numbers]), self.best[numbers] & (numbers >= 0)


class Aligner:
    """Aligned pieces that are remembered: a number for each, and by number its links, figures and, if asked for, its groups."""

    def __init__(self, known: Tokenizers, counts: LinkCounts | None = None, with_groups: bool = False):
        self.tokenizers, self.counts, self.b_size = known, counts, len(known.b_bytes)
        self.a_length = np.fromiter(map(len, known.a_bytes), np.int64)
        self.b_length = np.fromiter(map(len, known.b_bytes), np.int64)
        self.parts = known.group_parts() if with_groups else None
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.links: list[np.ndarray] = []
        self.stats = np.zeros((1 << 16, len(STATS)), np.int64)
        self.bad: set[str] = set()
        self.uncounted: set[str] = set()
        self.chars = 0

    @property
    def full(self) -> bool:
        return len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts end to end, and where each text's begin; none for texts without tokens."""
        cuts = [self.tokenizers.pieces(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(cuts)) if p not in self.numbers]
        if new:
            self._learn(new)
        if self.bad:
            cuts = [c if self.bad.isdisjoint(c) else [] for c in cuts]
        # pieces that occur only in texts without tokens are not counted
        if self.uncounted and any(not self.uncounted.isdisjoint(c) for c in cuts):
            raise RuntimeError("a pair of ids was not counted; the documents are others than those counted")
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cuts)), np.int64)
        return numbers, np.cumsum([0, *map(len, cuts)])

    def _learn(self, new: list[str]) -> None:
        known = self.tokenizers
        plain, others = [], []
        for piece in new:
            (plain if is_plain(piece) else others).append(piece)
        new = plain + others
        a_ids, b_lists = known.encode(plain, others)
        spelled = [(" " + p).encode("utf-8", "surrogatepass") for p in new]
        b_flat = list(chain.from_iterable(b_lists))
        b_ids = np.array(b_flat, np.int64)
        whole = b"".join(spelled)
        piece_ends = np.cumsum([*map(len, spelled)])
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        b_to = np.cumsum([*map(len, b_lists)])
        fits = (b"".join(map(known.a_bytes.__getitem__, a_ids.tolist())) == whole
                == b"".join(map(known.b_bytes.__getitem__, b_flat)))
        if not fits or not (np.append(0, b_ends)[b_to] == piece_ends).all():
            bad = {p for p, b in zip(new, b_lists) if known.misspelled(p, b)}
            self._number(sorted(bad), np.zeros((len(bad), len(STATS)), np.int64), [""] * len(bad))
            self.bad |= bad
            new = [p for p in new if p not in bad]
            return self._learn(new) if new else None
        mark = np.zeros(len(whole) + 1, bool)
        mark[b_ends] = True
        a_last = mark[a_ends]
        mark[:] = False
        mark[a_ends] = True
        b_last = mark[b_ends]
        a_to = np.searchsorted(a_ends, piece_ends, side="right")
        links_to = np.append(0, np.cumsum(a_last))[a_to]
        pairs = a_ids[a_last] * self.b_size + b_ids[b_last]
        stats = np.zeros((len(new), len(STATS)), np.int64)
        for column, to in enumerate((a_to, b_to, links_to, links_to)):
            stats[:, column] = np.diff(to, prepend=0)
        if self.counts is not None:
            count, best = self.counts.of(pairs)
            owner = np.repeat(np.arange(len(new)), stats[:, 3])
            self.uncounted.update(new[i] for i in set(owner[count < 0].tolist()))
            for column, value in ((4, best), (5, count)):
                stats[:, column] = np.diff(np.append(0, np.cumsum(value.astype(np.int64)))[links_to], prepend=0)
        self._number(new, stats, self._groups(a_ids, b_ids, a_last, b_last, a_to + b_to) if self.parts else [])
        self.links.append(pairs)

    def _number(self, new: list[str], stats: np.ndarray, groups: list[str]) -> None:
        first = len(self.numbers)
        while first + len(new) > len(self.stats):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)])
        self.stats[first:first + len(new)] = stats
        self.numbers.update(zip(new, range(first, first + len(new))))
        self.groups += groups if self.parts else []
        self.chars += sum(map(len, new))

    def _groups(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, to: np.ndarray) -> list[str]:
        """The groups of each piece as text: a group's ids of A stand before its ids of B."""
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_end, b_start = np.flatnonzero(a_last) + 1, np.append(0, np.flatnonzero(b_last) + 1)
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + b_start[a_group]] = 2 * a_ids + a_last
        order[np.arange(len(b_ids)) + a_end[b_group]] = 2 * (len(self.a_length) + b_ids) + b_last
        parts = list(map(self.parts.__getitem__, order.tolist()))
        ends = to.tolist()
        return ["".join(parts[start:end]) for start, end in zip([0, *ends], ends)]

    def link_counts(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the links of pieces that occur so many times each, and how often they are linked."""
        links = np.concatenate([*self.links, np.empty(0, np.int64)])
        times = np.repeat(times, self.stats[:len(self.numbers), 3])
        pairs, place = np.unique(links[times > 0], return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, place, times[times > 0])
        return pairs, sums


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(byte_file: str, piece_model: str) -> Tokenizers:
    """The worker's own instance; it outlives a task."""
    if (byte_file, piece_model) not in _LOADED:
        _LOADED[byte_file, piece_model] = Tokenizers(byte_file, piece_model)
    return _LOADED[byte_file, piece_model]


def task_counts(docs: DataFrame, byte_file: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """First pass: ``part``, ``pair`` and ``n`` for the linked pairs of every task's documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers_of(byte_file, piece_model))
        part, total, times = TaskContext.get().partitionId(), {}, np.zeros(0, np.int64)

        def settle() -> None:
            for pair, n in zip(*(x.tolist() for x in aligner.link_counts(times))):
                total[pair] = total.get(pair, 0) + n

        for batch in slices(batches, BATCH_ROWS):
            numbers, _ = aligner.cut(batch.column(0).to_pylist())
            seen = np.bincount(numbers, minlength=len(aligner.numbers))
            seen[:len(times)] += times
            times = seen
            if aligner.full:
                settle()
                aligner.clear()
                times = times[:0]
        settle()
        pairs = sorted(total)
        for start in range(0, len(pairs), 1 << 16):
            some = pairs[start:start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), pa.array(some, pa.int64()),
                                              pa.array([total[p] for p in some], pa.int64())], ["part", "pair", "n"])

    return docs.select(text_col).mapInArrow(counted, "part int, pair long, n long")


def _vectors(rows: DataFrame, size: int, add) -> DataFrame:
    """One vector for each task that has rows: ``add(vector, batch)`` over its batches."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, any_rows = np.zeros(size, np.int64), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            add(vector, batch)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([vector.tobytes()], pa.binary())], ["node", "vector"])

    return stored(rows.mapInArrow(summed, "node int, vector binary"))


def tree_sum(task_rows: DataFrame, hashed: PerfectHash, fan_in: int = FAN_IN) -> np.ndarray:
    """The counts of all tasks, by number of the pair."""

    def dense(vector: np.ndarray, batch: pa.RecordBatch) -> None:
        np.add.at(vector, hashed.find(batch.column(0).to_numpy()), batch.column(1).to_numpy())

    def children(vector: np.ndarray, batch: pa.RecordBatch) -> None:
        for child in batch.column(0):
            vector += np.frombuffer(child.as_py(), np.int64)

    nodes = _vectors(task_rows.select("pair", "n"), len(hashed), dense)
    while (left := nodes.count()) > 1:
        parents = -(-left // fan_in)
        dealt = nodes.repartitionById(parents, F.pmod("node", F.lit(parents)).cast("int")).select("vector")
        nodes = _vectors(dealt, len(hashed), children)
    last = nodes.first()
    return np.frombuffer(last["vector"], np.int64) if last else np.zeros(len(hashed), np.int64)


def count_links(docs: DataFrame, byte_file: str, piece_model: str, text_col: str = "text") -> LinkCounts:
    """First pass over all documents; the driver holds one number for each distinct pair, which the vocabularies bound."""
    known = Tokenizers(byte_file, piece_model)
    rows = stored(task_counts(docs, byte_file, piece_model, text_col))
    pairs = rows.select("pair").distinct().toArrow().column("pair").to_numpy()
    if len(pairs) > known.most_pairs():
        raise RuntimeError(f"{len(pairs)} linked pairs, more than the vocabularies allow")
    hashed = PerfectHash(np.sort(pairs))
    return LinkCounts(hashed, tree_sum(rows, hashed), len(known.b_bytes))


def align(docs: DataFrame, byte_file: str, piece_model: str, counts: LinkCounts | None = None, id_col: str = "doc_id",
          text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Second pass: tokens, groups, links, best links, sum of the links' counts and the digest of the groups of every row.

    ``counts`` are those of the documents themselves unless given; ``with_groups`` adds the groups as text.
    """
    counts = counts or count_links(docs, byte_file, piece_model, text_col)

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers_of(byte_file, piece_model), counts, True)
        for batch in slices(batches, BATCH_ROWS):
            numbers, ends = aligner.cut(batch.column(1).to_pylist())
            running = np.zeros((len(numbers) + 1, len(STATS)), np.int64)
            np.cumsum(aligner.stats[numbers], axis=0, out=running[1:])
            sums = running[ends[1:]] - running[ends[:-1]]
            of = list(map(aligner.groups.__getitem__, numbers.tolist()))
            texts = ["".join(of[a:b])[:-1] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            digests = [hashlib.sha256(t.encode("ascii")).hexdigest() if t else "" for t in texts]
            columns = [batch.column(0), *(pa.array(sums[:, k]) for k in range(len(STATS))), pa.array(digests, pa.string())]
            if with_groups:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, *STATS, "groups_sha256", "groups"][:len(columns)])
            if aligner.full:
                aligner.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", groups_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(reported, schema + ", groups string" * with_groups)
