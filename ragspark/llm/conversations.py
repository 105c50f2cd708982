"""Repair of conversation structure: the cheapest edits that give role initials ``(s?(ua)+)?``, by grammar-compressed DP.

Every row is a symbol, made of its role's initial (s, u, a, other) and its first fault (none, blank, duplicate, truncated). A
symbol's effect is a min-plus matrix over the four states of the role automaton: for each pair of states the least cost and,
as a rope, the least of the cheapest audits. Matrices are multiplied along a sequence. Re-Pair turns the frequent pairs of
symbols of a batch of conversations into rules; a rule's matrix is computed once, from those of its two parts, and serves
every conversation and every later batch of the worker. What is left of a sequence is folded, long ones in a balanced tree.

How the rows move, so that one conversation may hold any share of them:

1. Rows are range-partitioned and sorted by conversation, turn (nulls first) and a digest of role and text, so a large
   conversation lies in several tasks. Tasks pack neighbouring rows to runs of bounded size: symbols, roles and texts.
2. The runs' symbols, one letter for a row, come together for each conversation and give the figures and the audit. (The audit
   itself is one value with a letter for a row.) The audit is cut for the runs.
3. Runs apply their part of the audit. The digest of a conversation in one run is taken there; of others the repaired lines
   travel as blocks, in order, and are hashed as a stream, as SHA-256 cannot be put together from parts.

A duplicate's first occurrence is the least turn of its role and text, found by an aggregate with partial sums; within a
turn equal rows are neighbours after sorting.

Rows of one turn are ordered by the digest, so a result does not depend on the order of the input. Null roles and texts are
one space. Rows with a null conversation id are one conversation. Turns that are null come first and do not count for gaps.
Repeated rows are duplicates. Extra columns are not read. An empty table gives an empty result; conversations that are only
in ``all_ids`` have zeros, an empty audit and the digest of an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import slices, stored

#: Costs of the edits, role initials, and the faults in the order in which they count.
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
INITIALS = "sua"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SENTENCE_ENDS = ".!?"
#: States: nothing yet, after system, after user, after assistant; where each initial leads.
STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}

RUN_ROWS, RUN_CHARS = 4096, 1 << 20
BATCH_ROWS = 1024
#: Rules and whole sequences a worker remembers, and items folded one after the other.
MOST_RULES, MOST_KNOWN, IN_A_ROW = 50_000, 200_000, 32
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Rope:
    """A string as a tree of its parts, with its length and a hash; parts are shared."""

    __slots__ = ("size", "hash", "left", "right")
    PRIME, BASE = (1 << 61) - 1, 911_382_323_737_011

    def __init__(self, size: int, value: int, left, right) -> None:
        self.size, self.hash, self.left, self.right = size, value, left, right

    @staticmethod
    def letter(c: str) -> Rope:
        return Rope(1, ord(c), c, None)

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return other if not self.size else self
        value = (self.hash * pow(Rope.BASE, other.size, Rope.PRIME) + other.hash) % Rope.PRIME
        return Rope(self.size + other.size, value, self, other)

    def __lt__(self, other: Rope) -> bool:
        """Whether this string is ASCII-less; equal parts are passed over by their hashes."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b or (a.size == b.size and a.hash == b.hash):
                continue
            if a.size == b.size == 1:
                return a.left < b.left
            if a.size >= b.size:
                mine += [a.right, a.left]
                theirs.append(b)
            else:
                theirs += [b.right, b.left]
                mine.append(a)
        return bool(theirs)

    def __str__(self) -> str:
        out, left = [], [self] if self.size else []
        while left:
            rope = left.pop()
            if rope.right is None:
                out.append(rope.left)
            else:
                left += [rope.right, rope.left]
        return "".join(out)


NOTHING = Rope(0, 0, None, None)
D, I, K, R = map(Rope.letter, "DIKR")
Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def _better(a: Entry | None, b: Entry) -> Entry:
    return b if a is None or b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]) else a


def _times(row: list[Entry | None], matrix: Matrix) -> list[Entry | None]:
    out: list[Entry | None] = [None] * 4
    for entry, to in zip(row, matrix):
        if entry is not None:
            for j, step in enumerate(to):
                if step is not None:
                    cost, held = entry[0] + step[0], out[j]
                    if held is None or cost <= held[0]:
                        out[j] = _better(held, (cost, entry[1] + step[1]))
    return out


def _inserts() -> Matrix:
    matrix: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        state, cost, audit = i, 0, NOTHING
        for _ in range(3):
            matrix[i][state] = _better(matrix[i][state], (cost, audit))
            state = next(s for c, s in STEPS[state].items() if c != "s")
            cost, audit = cost + INSERT, audit + I
    return matrix


INSERTS = _inserts()


def letter(initial: str, fault: int) -> str:
    """The letter of a row in a sequence."""
    return chr(65 + 4 * (INITIALS + " ").index(initial if initial and initial in INITIALS else " ") + fault)


def _symbol(number: int) -> Matrix:
    """A row's matrix: inserts before it, then keep, rerole or delete."""
    (place, fault), step = divmod(number, 4), [[None] * 4 for _ in range(4)]
    for i in range(4):
        step[i][i] = (DELETE, D)
        if fault in (OK, TRUNCATED):
            extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
            for c, to in STEPS[i].items():
                if c != "s":
                    step[i][to] = (REROLE + extra, R)
            kept = STEPS[i].get((INITIALS + " ")[place])
            if kept is not None:
                step[i][kept] = (extra, K)
    return [_times(row, step) for row in INSERTS]


class Grammar:
    """Matrices of symbols and of rules, which are pairs of symbols or rules."""

    def __init__(self) -> None:
        self.matrices = [_symbol(n) for n in range(16)]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, a: int, b: int) -> int:
        number = self.rules.get((a, b))
        if number is None:
            number = self.rules[a, b] = len(self.matrices)
            self.matrices.append([_times(row, self.matrices[b]) for row in self.matrices[a]])
        return number

    def compress(self, sequences: list[str]) -> list[list[int]]:
        """The sequences with their frequent pairs replaced by rules, the most frequent pair of all of them first."""
        flat = np.frombuffer("".join(s + "@" for s in sequences).encode("ascii"), np.uint8).astype(np.int64) - 65
        while len(flat) > 1:
            inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
            pairs, counts = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_counts=True)
            if not len(pairs) or counts.max() < max(4, len(flat) // 256):
                break
            a, b = divmod(int(pairs[counts.argmax()]), 1 << 32)
            at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
            if a == b:  # in a run of the same symbol every second place, from the left
                heads = np.flatnonzero(np.append(True, np.diff(at) != 1))
                at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]
            flat[at] = self.rule(a, b)
            flat = np.delete(flat, at + 1)
        ends = np.flatnonzero(flat < 0)
        return [flat[start + 1:end].tolist() for start, end in zip([-1, *ends[:-1]], ends)]

    def cheapest(self, items: list[int]) -> tuple[int, str]:
        """Cost and audit of a compressed sequence."""
        while len(items) > IN_A_ROW:
            odd = items[-1:] if len(items) % 2 else []
            items = [self.rule(a, b) for a, b in zip(items[::2], items[1::2])] + odd
        row: list[Entry | None] = [(0, NOTHING), None, None, None]
        for item in items:
            row = _times(row, self.matrices[item])
        row, best = _times(row, INSERTS), None
        for state in ENDS:
            if row[state] is not None:
                best = _better(best, row[state])
        return best[0], str(best[1])


class Solver:
    """Cheapest edits of sequences, remembered by the worker."""

    def __init__(self) -> None:
        self.grammar, self.known = Grammar(), {}

    def of(self, sequences: list[str]) -> list[tuple[int, str]]:
        if len(self.grammar.matrices) > MOST_RULES:
            self.grammar = Grammar()
        if len(self.known) > MOST_KNOWN:
            self.known = {}
        new = [s for s in dict.fromkeys(sequences) if s not in self.known]
        found = dict(zip(new, map(self.grammar.cheapest, self.grammar.compress(new))))
        self.known.update((s, f) for s, f in found.items() if len(s) <= 64)
        return [found[s] if s in found else self.known[s] for s in sequences]


def figures(sequence: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials are not legal."""
    codes = np.frombuffer(sequence.encode("ascii"), np.uint8) - 65
    faults, initials = codes % 4, codes // 4
    before, after = initials[:-1], initials[1:]
    legal = ((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1))
    return (*(int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int(len(legal) - legal.sum()))


def _next_state(state: int, edit: str, symbol: str) -> int:
    if edit == "D":
        return state
    if edit == "K":
        return STEPS[state][(INITIALS + " ")[(ord(symbol) - 65) // 4]]
    return next(s for c, s in STEPS[state].items() if c != "s")


def cut_audit(audit: str, parts: list[str]) -> list[tuple[str, int]]:
    """For each part of a sequence its edits and the state before them. Inserts go with the next row, the last ones with
    the last part."""
    if len(parts) == 1:
        return [(audit, 0)]
    out, at, state = [], 0, 0
    for number, part in enumerate(parts):
        start, begin, row = at, state, 0
        while at < len(audit) and (row < len(part) or number == len(parts) - 1):
            inserted = audit[at] == "I"
            state = _next_state(state, audit[at], "" if inserted else part[row])
            row += not inserted
            at += 1
        out.append((audit[start:at], begin))
    return out


def repaired_lines(edits: str, state: int, symbols: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of what the edits leave of some rows."""
    lines, row = [], 0
    for edit in edits:
        symbol = "" if edit == "I" else symbols[row]
        state = _next_state(state, edit, symbol)
        if edit == "I":
            lines.append(ROLES[state] + ":")
            continue
        if edit != "D":
            lines.append(f"{roles[row] if edit == 'K' else ROLES[state]}:{texts[row]}")
        row += 1
    return lines


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows as a careless export leaves them: by ``crc32(id:turn) % 20`` dropped, emptied, without sentence ends, repeated,
    or with the role user. Nulls are one space."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space(id_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(or_space(text_col), SENTENCE_ENDS, "")).otherwise(
        or_space(text_col))
    left = rows.select(id_col, turn_col, role_col, text_col, kind.alias("kind")).where("kind <> 0")
    return left.select(id_col, turn_col, F.when(F.col("kind") == 4, "user").otherwise(or_space(role_col)).alias(role_col),
                       text.alias(text_col), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
                           F.array(F.lit(0)))).alias("copy")).drop("copy")


def _runs(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Runs of neighbouring rows of one conversation; ``rows`` are conv, turn, role, text, late, there and sorted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv_type = TaskContext.get().partitionId() << 34, None
        now, previous, out, chars = None, None, [], 0
        symbols, roles, texts, turns = [], [], [], []

        def close() -> None:
            nonlocal number, chars
            if now is not None:
                known = [t for t in turns if t is not None]
                out.append((number, now[0], "".join(symbols), len(set(known)), known[0] if known else None,
                            known[-1] if known else None, list(roles), list(texts)))
                number += 1
            for column in (symbols, roles, texts, turns):
                column.clear()
            chars = 0

        def records() -> pa.RecordBatch:
            types = [pa.int64(), conv_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
                     pa.list_(pa.string())]
            columns = list(zip(*out)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                              ["run", "conv", "symbols", "n_turns", "first", "last", "roles", "texts"])

        for batch in slices(batches, BATCH_ROWS):
            conv_type, held = batch.schema.field("conv").type, 0
            for conv, turn, role, text, late, there in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv or len(symbols) >= most_rows or chars >= most_chars:
                    held += chars
                    close()
                    if held > 8 * most_chars:
                        yield records()
                        held = 0
                    if now is None or now[0] != conv:
                        previous = None
                    now = (conv,)
                if not there:
                    continue
                bare = text.strip(SPACES)
                row = turn, role, text
                fault = (BLANK if not bare else DUPLICATE if late or row == previous
                         else TRUNCATED if bare[-1] not in SENTENCE_ENDS else OK)
                previous = row
                symbols.append(letter(role[:1], fault))
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                chars += len(role) + len(text)
            if out:
                yield records()
        close()
        if out:
            yield records()

    kind = rows.schema["conv"].dataType.simpleString()
    return stored(rows.mapInArrow(pack, f"run long, conv {kind}, symbols string, n_turns long, first long, last long, "
                                        "roles array<string>, texts array<string>"))


_SOLVERS: list[Solver] = []


def _solved(runs: DataFrame) -> DataFrame:
    """Figures and audit of every conversation, and the part of the audit for each of its runs."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SOLVERS:
            _SOLVERS.append(Solver())
        for batch in slices(batches, BATCH_ROWS):
            lists = [sorted(x, key=lambda r: r["run"]) for x in batch.column(1).to_pylist()]
            parts = [[r["symbols"] for r in x] for x in lists]
            sequences = ["".join(p) for p in parts]
            rows = []
            for runs, sequence, symbols, (cost, audit) in zip(lists, sequences, parts, _SOLVERS[0].of(sequences)):
                known = [r for r in runs if r["n_turns"]]
                shared = sum(a["last"] == b["first"] for a, b in zip(known, known[1:]))
                different = sum(r["n_turns"] for r in known) - shared
                gaps = known[-1]["last"] - known[0]["first"] + 1 - different if known else 0
                cut = [{"run": r["run"], "edits": e, "state": s} for r, (e, s) in zip(runs, cut_audit(audit, symbols))]
                rows.append((gaps, *figures(sequence), cost, audit, runs[0]["run"], cut))
            columns = list(zip(*rows)) or [()] * (len(FIGURES) + 3)
            cut_type = pa.list_(pa.struct([("run", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
            types = [*[pa.int64()] * len(FIGURES), pa.string(), pa.int64(), cut_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                                             ["conv", *FIGURES, "audit", "home", "cut"])

    kind = runs.schema["conv"].dataType.simpleString()
    gathered = runs.groupBy("conv").agg(F.collect_list(F.struct("run", "symbols", "n_turns", "first", "last")).alias("runs"))
    return stored(gathered.mapInArrow(
        solve, f"conv {kind}, " + ", ".join(f"{f} long" for f in FIGURES)
        + ", audit string, home long, cut array<struct<run: long, edits: string, state: int>>"))


def _applied(edited: DataFrame) -> DataFrame:
    """The repaired lines of runs with their edits: the digest, or for runs of larger conversations the lines."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            blocks, digests = [], []
            for whole, edits, state, symbols, roles, texts in zip(*(c.to_pylist() for c in batch.columns[2:])):
                lines = repaired_lines(edits, state, symbols, roles, texts)
                block = "\n".join(lines).encode("utf-8", "surrogatepass")
                blocks.append(None if whole or not lines else block)
                digests.append(hashlib.sha256(block).hexdigest() if whole else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.binary()),
                                              pa.array(digests, pa.string())], ["home", "run", "block", "repaired_sha256"])

    columns = edited.select("home", "run", "whole", "edits", "state", "symbols", "roles", "texts")
    return columns.mapInArrow(apply, "home long, run long, block binary, repaired_sha256 string")


def _hashed(blocks: DataFrame) -> DataFrame:
    """One digest for the blocks of each conversation, which stream by in their order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_lines = None, None, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                              ["home", "repaired_sha256"])

        for batch in slices(batches, 16):
            for home, _, block in zip(*(c.to_pylist() for c in batch.columns)):
                if home != now:
                    if now is not None:
                        yield row()
                    now, state, any_lines = home, hashlib.sha256(), False
                if block is not None:
                    state.update(b"\n" + block if any_lines else block)
                    any_lines = True
        if now is not None:
            yield row()

    dealt = blocks.select("home", "run", "block").repartition("home").sortWithinPartitions("home", "run")
    return dealt.mapInArrow(digest, "home long, repaired_sha256 string")


def repair(rows: DataFrame, all_ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text", run_rows: int = RUN_ROWS, run_chars: int = RUN_CHARS) -> DataFrame:
    """``id_col``, the figures, ``audit`` and ``repaired_sha256`` of every conversation in ``rows`` or ``all_ids``."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    plain = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        or_space(role_col).alias("role"), or_space(text_col).alias("text"))
    spelled = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    content = F.unhex(F.sha2(spelled, 256))
    keyed = plain.select("*", content.alias("content"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("when"))
    again = keyed.groupBy("conv", "content").agg(F.min("when").alias("least"), F.max("when").alias("most"))
    again = stored(again.where("least < most").select(F.col("conv").alias("of"), F.col("content").alias("same"), "least"))
    marked = keyed.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")), "left").select(
        "conv", "turn", "role", "text", F.coalesce(F.col("when") > F.col("least"), F.lit(False)).alias("late"),
        F.lit(True).alias("there"), "content")
    if all_ids is not None:
        marked = marked.unionByName(all_ids.select(F.col(id_col).alias("conv")).distinct().select(
            "conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
            F.lit(False).alias("late"), F.lit(False).alias("there"), F.lit(None).cast("binary").alias("content")))
    in_order = marked.repartitionByRange("conv", "turn", "content").sortWithinPartitions("conv", "turn", "content")
    runs = _runs(in_order.drop("content"), run_rows, run_chars)
    solved = _solved(runs)
    whole = F.size("cut") == 1
    edits = solved.select("home", whole.alias("whole"), F.explode("cut").alias("part")).select(
        "home", "whole", "part.run", "part.edits", "part.state")
    applied = stored(_applied(edits.join(runs.select("run", "symbols", "roles", "texts"), "run")))
    done = applied.where("repaired_sha256 is not null").select("home", "repaired_sha256")
    in_blocks = applied.where("repaired_sha256 is null")
    return solved.join(done.unionByName(_hashed(in_blocks)), "home").select(
        F.col("conv").alias(id_col), *FIGURES, "audit", "repaired_sha256")
