"""Removal of repeated passages: windows of ``size`` words that also start in a document with a smaller id.

Super-k-mers: the minimiser of a window is the smallest hash among its runs of ``MINIMISER`` words, and consecutive
windows with the same minimiser form one super-k-mer. Equal windows have equal minimisers, so

1. every document yields one narrow row per super-k-mer, with the minimiser and a hash of the words it spans;
2. minimisers that occur in one document only cannot belong to a repeated window and are left out by an aggregate;
3. equal super-k-mers count once, with their smallest document id (map-side, so large groups of copies stay small);
   each of the rest travels as one packed string of words to the bucket of its minimiser. A minimiser with very many
   different strings is cut into its windows, which are dealt out by their own words;
4. in a bucket the windows are sorted; a run of equal ones has one smallest document;
5. a document removes the windows whose smallest document is another one, and joins them to spans.

Windows are judged on the input. Null and empty texts have no words. Ids are compared as numbers; rows without an id
come after all others and are not compared with each other. Rows that repeat an id and its text get equal results; rows
of one id with different texts are one document for the comparison. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import WordHashes, mixed, slices, stored, text_key, window_hashes, words_of

SIZE = 50
MINIMISER = 16
BATCH_ROWS = 256
#: Words and strings that are hashed and compared in one pass, if that many come together.
BATCH_WORDS = 100_000
BUCKET_STRINGS = 2000
STRINGS_PER_BUCKET = 4000
LAST = (1 << 63) - 1
_SECOND = 0xC2B2AE3D27D4EB4F


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of ``width`` values, by blocks of prefix and suffix minima."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(values)] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def super_kmers(hashes: np.ndarray, counts: np.ndarray, size: int,
                minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, minimiser, first window, number of windows and content hash of each super-k-mer.

    ``hashes`` are the words of several documents end to end, ``counts`` their numbers of words. All windows are looked at
    in one pass; those that reach over the end of a document are left out.
    """
    owner, place = window_places(counts, size)
    if not len(owner):
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    smallest = smallest_in_windows(window_hashes(hashes, minimiser), size - minimiser + 1)[place]
    starts = np.flatnonzero(np.r_[True, (smallest[1:] != smallest[:-1]) | (owner[1:] != owner[:-1])])
    length = np.diff(np.r_[starts, len(owner)])
    # a polynomial over the words, so that the hash of any span is a difference of two prefix sums
    prefix = np.append(np.uint64(0), np.cumsum(mixed(hashes) * _powers(len(hashes)), dtype=np.uint64))
    span, at, owner = length + size - 1, place[starts], owner[starts]
    content = (prefix[at + span] - prefix[at]) * _inverse_powers(at)
    first = at - (np.cumsum(counts) - counts)[owner]
    return owner, smallest[starts], first, length, mixed(content ^ (span.astype(np.uint64) * np.uint64(_SECOND)))


def window_places(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """List and place of each window that lies within one of several lists of ``counts`` words, end to end."""
    windows = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    skipped = (np.cumsum(counts) - counts) - (np.cumsum(windows) - windows)
    return owner, np.arange(len(owner)) + skipped[owner]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64) if n else np.empty(0, np.uint64)


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    table = np.append(np.uint64(1), np.cumprod(np.full(int(at.max()) if len(at) else 0, _INVERSE, np.uint64), dtype=np.uint64))
    return table[at]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def dedup_substrings(docs: DataFrame, size: int = SIZE, minimiser: int = MINIMISER, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row its id, words, removed words, the SHA-256 of the kept words joined by blanks, and the removed spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, BATCH_ROWS):
            hashes, begin, held = [], 0, 0
            for row, text in enumerate(batch.column(2).to_pylist()):
                hashes.append(table.of(words_of(text)))
                held += len(hashes[-1])
                if held >= BATCH_WORDS:
                    yield kmers_of(hashes, batch.slice(begin, row + 1 - begin))
                    hashes, begin, held = [], row + 1, 0
            if hashes:
                yield kmers_of(hashes, batch.slice(begin))

    def kmers_of(hashes: list[np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([len(h) for h in hashes], np.int64)
        owner, mini, start, length, content = super_kmers(np.concatenate(hashes), counts, size, minimiser)
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), signed(mini), pa.array(start.astype(np.int32)),
             pa.array(length.astype(np.int32)), signed(content)],
            ["doc", "key", "mini", "start", "windows", "content"])

    kmers = stored(rows.mapInArrow(cut, "doc long, key long, mini long, start int, windows int, content long"))
    owner = F.coalesce("doc", F.lit(LAST))
    shared = (kmers.groupBy("mini").agg(F.min(owner).alias("a"), F.max(owner).alias("b"), F.count("*").alias("n"))
              .where("a < b or n > 1").select("mini"))
    repeated = stored(kmers.join(shared, "mini", "left_semi"))
    # one holder for each different super-k-mer; a document that repeats itself holds several
    different = repeated.groupBy("mini", "content", "windows").agg(
        F.min(F.struct(owner.alias("doc_min"), F.col("doc"), F.col("key"), F.col("start"))).alias("h"))
    different = different.select("mini", "content", "windows", "h.*")
    many = different.groupBy("mini").agg(F.count("*").alias("strings"))
    different = stored(different.join(many, "mini"))
    strings = stored(_texts(rows, different, size))
    smallest = _buckets(strings, size)
    found = smallest.groupBy("mini", "content").agg(F.collect_list(F.struct("at", "docs")).alias("parts"))
    removed = (repeated.join(found, ["mini", "content"])
               .select("doc", "key", "start", F.explode("parts").alias("part"))
               .mapInArrow(_removed_runs, "doc long, key long, start int, stop int"))
    spans = removed.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return _applied(rows, stored(spans), size, id_col)


def _texts(rows: DataFrame, different: DataFrame, size: int) -> DataFrame:
    """The packed string of each different super-k-mer, cut from its holder's text; long lists are cut into windows."""
    wanted = different.groupBy("doc", "key").agg(
        F.collect_list(F.struct("mini", "content", "windows", "start", "strings", "doc_min")).alias("wanted"))
    held = rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]) & rows["doc"].eqNullSafe(wanted["doc"]))
    held = held.select("text", "wanted")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        names = ("mini", "content", "windows", "start", "strings", "doc_min")
        for batch in slices(batches, 32):
            out: list[tuple] = []
            listed = batch.column(1)
            every = listed.flatten()
            fields = zip(*(every.field(n).to_pylist() for n in names))
            for text, n_listed in zip(batch.column(0).to_pylist(), pc.list_value_length(listed).to_pylist()):
                words = words_of(text)
                for mini, content, n, begin, different, doc_min in itertools.islice(fields, n_listed):
                    parts = -(-different // STRINGS_PER_BUCKET)
                    pieces = [(0, n)] if parts == 1 else [(i, 1) for i in range(n)]
                    for at, count in pieces:
                        packed_words = " ".join(words[begin + at:begin + at + count + size - 1])
                        part = 0 if parts == 1 else xxhash.xxh3_64_intdigest(packed_words.encode()) % parts
                        out.append((mini, part, content, at, doc_min, packed_words))
                if len(out) >= 4000:
                    yield _rows(out, _STRING_KINDS, _STRING_NAMES)
                    out = []
            if out:
                yield _rows(out, _STRING_KINDS, _STRING_NAMES)

    # a row that occurs twice gives its strings twice, which changes no smallest id
    return held.mapInArrow(strings, "mini long, part int, content long, at int, doc_min long, words string")


_STRING_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string())
_STRING_NAMES = ["mini", "part", "content", "at", "doc_min", "words"]


def _rows(out: list[tuple], kinds, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _buckets(strings: DataFrame, size: int) -> DataFrame:
    """For each string the smallest document of each of its windows."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, rows, last = WordHashes(), [], 0, None
        for batch in slices(batches, 1000):
            mini, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.r_[last != (mini[0], part[0]), (mini[1:] != mini[:-1]) | (part[1:] != part[:-1])]
            # the groups before the batch's last one are whole
            edge, last = (int(np.flatnonzero(new)[-1]) if new.any() else None), (mini[-1], part[-1])
            if edge is not None and rows + edge >= BUCKET_STRINGS:
                yield _resolved([*held, batch.slice(0, edge)], table, size)
                held, rows, batch = [], 0, batch.slice(edge)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield _resolved(held, table, size)

    dealt = strings.repartition("mini", "part").sortWithinPartitions("mini", "part")
    return dealt.mapInArrow(bucket, "mini long, content long, at int, docs array<long>")


def _resolved(held: list[pa.RecordBatch], table: WordHashes, size: int) -> pa.RecordBatch:
    """Sort the windows of whole buckets by two independent 64-bit hashes and give each string its windows' smallest ids.

    Equal windows have equal minimisers and parts, so windows of different buckets differ.
    """
    mini, _, content, place, docs, words = pa.Table.from_batches(held).combine_chunks().columns
    texts = words.to_pylist()
    counts = np.array([t.count(" ") + 1 for t in texts], np.int64)
    hashes = table.of(" ".join(texts).split(" "))
    string, at = window_places(counts, size)
    a = window_hashes(hashes, size)[at]
    b = window_hashes(mixed(hashes ^ np.uint64(_SECOND)), size, _SECOND)[at]
    owner = docs.to_numpy()[string]
    order = np.lexsort((b, a))
    edge = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    starts = np.flatnonzero(edge)
    least = np.minimum.reduceat(owner[order], starts)
    smallest = np.empty(len(a), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.r_[starts, len(a)]))
    ends = np.r_[0, np.cumsum(counts - size + 1)].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [*(c.combine_chunks() for c in (mini, content, place)), pa.ListArray.from_arrays(pa.array(ends), pa.array(smallest))],
        ["mini", "content", "at", "docs"])


def _removed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of window starts whose smallest document is not the row's own."""
    for batch in slices(batches, 2000):
        out = []
        for doc, key, start, part in zip(*(c.to_pylist() for c in batch.columns)):
            less = np.array(part["docs"]) < (LAST if doc is None else doc)
            edges = np.flatnonzero(np.diff(np.r_[False, less, False].astype(np.int8)))
            out += [(doc, key, start + part["at"] + a, start + part["at"] + b)
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if out:
            yield _rows(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["doc", "key", "start", "stop"])


def _applied(rows: DataFrame, spans: DataFrame, size: int, id_col: str) -> DataFrame:
    """Every row with its words removed; rows without spans pass the join with null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            out = []
            for doc, text, listed in zip(*(c.to_pylist() for c in batch.columns)):
                words, kept, at, cuts = words_of(text), [], 0, []
                for span in listed or ():
                    begin, end = span["start"], span["stop"] + size - 1
                    if cuts and begin <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], end)
                    else:
                        cuts.append([begin, end])
                for begin, end in cuts:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                digest = hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((doc, len(words), len(words) - len(kept), digest, ",".join(f"{a}:{b}" for a, b in cuts)))
            yield _rows(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()),
                        [id_col, "n_words", "n_removed", "kept_sha256", "removed_spans"])

    joined = rows.join(spans.withColumnRenamed("doc", "span_doc").withColumnRenamed("key", "span_key"),
                       rows["key"].eqNullSafe(F.col("span_key")) & rows["doc"].eqNullSafe(F.col("span_doc")), "left")
    return joined.select("doc", "text", "spans").mapInArrow(
        apply, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, removed_spans string")


#: The same in DuckDB's SQL.
ORACLE = f"""
with words as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents),
windows as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + {SIZE - 1}), ' ')) as h
            from (select doc_id, w, unnest(range(1, len(w) - {SIZE - 2})) as i from words where len(w) >= {SIZE})),
least as (select h, min(doc_id) as least from windows group by 1),
starts as (select doc_id, list_distinct(flatten(list(range(i, i + {SIZE})))) as gone
           from windows join least using (h) where least < doc_id group by 1),
kept as (select doc_id, w, coalesce(len(gone), 0) as n_removed,
         case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
              lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end as k from words left join starts using (doc_id))
select doc_id, len(w) as n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
