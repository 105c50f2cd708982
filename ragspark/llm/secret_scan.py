"""Secret scans: fixed patterns, and strings whose sliding-window entropy is high for their character class.

The patterns of ``BASE`` are found as they stand. Every other unbroken string of one of the entropy classes is a
candidate: a window slides over it, the counts of its characters are kept up to date as one character enters and one
leaves, and with them the sum of ``c * log2(c)``, hence the Shannon entropy. Windows at or above the class's bound are
joined to spans. Candidates that touch a base span are left out, and those the allow-list knows: strings that are a word
path as a whole, consist of words but for a few signs (paths and identifiers with digits in them) or name themselves a
placeholder. Public pieces (UUIDs, digests with their name, alphabets, runs of x) are
left out themselves, and what lies beside them is a candidate of its own.

Positions are code points, ends exclusive. Null texts are empty and have no spans. Every row gives one row; repeated
rows are scanned alike, extra columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ragspark.llm.common import slices

#: Kinds in their order, patterns and least lengths.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
_KEYWORD = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
BATCH_ROWS = 512


@dataclass(frozen=True)
class EntropyClass:
    """Strings of one alphabet with at least ``least`` characters; windows of ``window`` need ``bits`` of entropy."""

    name: str
    pattern: str
    least: int
    window: int
    bits: float


#: Classes, windows and bounds. Base64-like strings need a digit, a lower-case and an upper-case letter.
CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{24,}(?![0-9A-Za-z])", 24, 24, 2.8),
    EntropyClass("entropy_base64",
                 r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])"
                 r"[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", 20, 20, 3.6),
    # lower-case letters and digits only: at least three runs of digits with letters behind them tell them from names
    EntropyClass("entropy_lower",
                 r"(?<![A-Za-z0-9+/_=-])(?=(?:[a-z]*+[0-9]++(?=[a-z])){3})[a-z0-9]{24,}(?![A-Za-z0-9+/_=-])", 24, 24, 3.6),
)
#: Words inside candidates, and the share of letters and digits from which on words make a candidate up.
WORDS = re.compile(r"[A-Z]?[a-z]{3,}+")
VOWEL = re.compile(r"[aeiouyAEIOUY]")
WORD_SHARE = 0.75
#: Candidates that look random but are known to be placeholders or, as a whole, paths of words.
ALLOWED = (
    re.compile(r"(?i).*(example|sample|placeholder|changeme|dummy).*"),
    re.compile(r"[A-Za-z]+([/_-][A-Za-z]+)+"),
)
#: Public pieces of candidates.
PIECES = re.compile(
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
    r"|(?<![0-9A-Za-z])sha(1-[0-9a-z+/]{27}=|256-[0-9a-z+/]{43}=|384-[0-9a-z+/]{64}|512-[0-9a-z+/]{86}==)(?![0-9a-z+/=])"
    r"|x{6,}|0123456789|abcdefghij", re.IGNORECASE)


def entropy_spans(string: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``string`` whose entropy is at least ``bits``; none if it is shorter than a window."""
    if len(string) < window:
        return []
    cost = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, top, spans = 0.0, math.log2(window), []
    for i, entering in enumerate(string):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += cost[c + 1] - cost[c]
        if i >= window:
            leaving = string[i - window]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += cost[c - 1] - cost[c]
        start = i - window + 1
        if start >= 0 and top - total / window >= bits - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns, in order."""
    found = []
    # the cheap tests only tell that a pattern cannot match
    possible = (_KEYWORD.search(text), "AKIA" in text, _LONG_HEX.search(text))
    for k, (_, pattern, group, least) in enumerate(BASE):
        if possible[k]:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def made_of_words(candidate: str) -> bool:
    """Whether words with a vowel make up ``WORD_SHARE`` of the letters and digits, and a separator or capital parts two."""
    words = [w for w in WORDS.findall(candidate) if VOWEL.search(w)]
    return len(words) > 1 and sum(map(len, words)) >= WORD_SHARE * sum(c.isalnum() for c in candidate)


def scan(text: str, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[re.Pattern, ...] = ALLOWED,
         pieces: re.Pattern = PIECES) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans as (start, kind, end) in order."""
    base = base_spans(text)
    added: list[tuple[int, int, str, int]] = []
    # a candidate meets a base span if one that starts before its end ends behind its start
    starts = [s for s, _, _ in base]
    reach = list(itertools.accumulate((e for _, _, e in base), max))
    for k, kind in enumerate(classes):
        for m in _compiled(kind.pattern).finditer(text):
            before = bisect.bisect_left(starts, m.end())
            if before and reach[before - 1] > m.start() or any(p.fullmatch(m[0]) for p in allowed) \
                    or made_of_words(m[0]):
                continue
            rest = pieces.sub(lambda p: " " * len(p[0]), m[0])
            parts = [(0, rest)] if rest == m[0] else [(p.start(), p[0]) for p in _compiled(kind.pattern).finditer(rest)]
            added += [(m.start() + at + a, len(BASE) + k, kind.name, m.start() + at + b)
                      for at, part in parts for a, b in entropy_spans(part, kind.window, kind.bits)]
    every = sorted([(s, k, BASE[k][0], e) for s, k, e in base] + added)
    return base, [(s, name, e) for s, _, name, e in every]


_COMPILED: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _COMPILED:
        _COMPILED[pattern] = re.compile(pattern)
    return _COMPILED[pattern]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and the text with every span masked."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, every = scan(text or "")
                listed = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in base)
                row = [*(sum(k == i for _, i, _ in base) for k in range(len(BASE))),
                       hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every),
                       masked(text, every)]
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]),
                 *(pa.array(c, pa.string()) for c in columns[3:])],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scanned, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                 "masked_text string")


def masked(text: str | None, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with the union of the spans replaced by ``mark``; null stays null."""
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start > at or not out:
            out += [text[at:start], mark]
        elif start == at:
            out.append(mark)
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span masked in the text, and the text's new length in ``length_col``; other columns stay."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(length_col) if length_col in docs.columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            clean = [masked(t, scan(t or "")[1]) for t in texts]
            columns[at] = pa.array(clean, pa.string())
            if count is not None:
                old = columns[count].to_pylist()
                new = [n if a == b else len(b) for n, a, b in zip(old, texts, clean)]
                columns[count] = pa.array(new, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
