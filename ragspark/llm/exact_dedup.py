"""Exact duplicates by Grace hashing: buckets of records that fit an open-addressing table comparing complete contents.

1. Every task collapses the equal texts of its own rows, so a text that a third of all rows share leaves each task a
   few times only. What leaves is a record: the content, its hash, and the ids of the rows that have it.
2. Records are dealt to buckets by a hash of their level. A bucket is measured on narrow columns by the contents it
   has to hold, each once. Buckets that fit are moved, one shuffle, and resolved one at a time; the records of the others are
   spilled to a table in the shared folder and dealt again with the hash of the next level, until every bucket fits.
3. In a bucket an open-addressing table finds the records with the same hash and then the same bytes, so equal hashes
   of different texts do no harm. It answers with the group's row count and largest id for each record.
4. Records take these answers back to their ids.

A bucket is a run of sorted rows, not a Spark partition, so their number can grow with the data while the partitions of one
shuffle stay bounded. A task holds the contents of one bucket, whatever the size of a group.

Null texts count as empty. Rows with a null id are members of their group; null is smaller than every id, so
``keep_id`` is null only where no member has an id. Of every group exactly one row is kept, repeated rows of the largest id
included. Ids may have any type that can be ordered. Only the id and the text are read, so extra columns cannot
clash. One row is returned for each row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import slices, stored

ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

BATCH_ROWS = 256
#: Bytes of contents and ids a task collapses at a time.
HELD_BYTES = 32 << 20
#: Mean and largest bytes of the different contents of a bucket.
TARGET_BYTES = 16 << 20
LIMIT_BYTES = 64 << 20
#: What a table entry costs beside its content.
ENTRY_BYTES = 96
#: Most partitions of one shuffle of contents.
FAN_OUT = 20_000


def content_hash(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


class ContentTable:
    """Open addressing with linear probing. Entries are equal if their hashes and their complete contents are."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def __len__(self) -> int:
        return len(self.contents)

    def entry(self, key: int, content: bytes) -> int:
        """The number of the content's entry; a new content gets the next number."""
        slots, hashes, contents = self.slots, self.hashes, self.contents
        mask = len(slots) - 1
        at = key & mask
        while (found := slots[at]) >= 0:
            if hashes[found] == key and contents[found] == content:
                return found
            at = (at + 1) & mask
        slots[at] = len(contents)
        hashes.append(key)
        contents.append(content)
        if 2 * len(contents) > len(slots):
            self._grow()
        return len(contents) - 1

    def _grow(self) -> None:
        self.slots = slots = [-1] * (4 * len(self.slots))
        mask = len(slots) - 1
        for number, key in enumerate(self.hashes):
            at = key & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = number


def _top(ids: list) -> int:
    """The place of the largest id; null is smaller than every id."""
    return max(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, -i))


def collapsed(docs: DataFrame, id_col: str, text_col: str, key_of: Callable[[bytes], int], held: int) -> DataFrame:
    """Records: the equal texts among some rows of one task."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 34
        kind = None

        def records(table: ContentTable, members: list[list]) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(table), BATCH_ROWS):
                some = slice(start, start + BATCH_ROWS)
                contents, ids = table.contents[some], members[some]
                tops = [_top(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(number + start, number + start + len(ids)), pa.int64()),
                    pa.array(table.hashes[some], pa.int64()),
                    pa.array([len(c) + ENTRY_BYTES for c in contents], pa.int64()),
                    pa.array(map(len, ids), pa.int64()), pa.array([x[t] for x, t in zip(ids, tops)], kind),
                    pa.array(tops, pa.int32()), pa.array(ids, pa.list_(kind)),
                    pa.array([hashlib.sha256(c).digest() for c in contents], pa.binary()),
                    pa.array(contents, pa.binary())],
                    ["rep", "key", "n_bytes", "n_rows", "top", "top_at", "ids", "sha", "content"])

        table, members, size = ContentTable(), [], 0
        for batch in slices(batches, BATCH_ROWS):
            kind = batch.schema.field(0).type
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = content or b""
                entry = table.entry(key_of(content), content)
                if entry == len(members):
                    members.append([])
                    size += len(content) + ENTRY_BYTES
                members[entry].append(key)
                size += 16
            if size > held:
                yield from records(table, members)
                number += len(table)
                table, members, size = ContentTable(), [], 0
        yield from records(table, members)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(
        collapse, f"rep long, key long, n_bytes long, n_rows long, top {kind}, top_at int, ids array<{kind}>, "
                  "sha binary, content binary")


def resolved(dealt: DataFrame, partitions: int) -> DataFrame:
    """For each record of the dealt buckets its group's largest id and row count, and whether it holds the kept row."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now = None, None
        table, entries, reps, tops, keepers, sizes = ContentTable(), [], [], [], [], []

        def answers() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(reps), 1 << 16):
                some = slice(start, start + (1 << 16))
                of = entries[some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(reps[some], pa.int64()), pa.array([tops[e] for e in of], kind),
                    pa.array([sizes[e] for e in of], pa.int64()),
                    pa.array([keepers[e] == r for e, r in zip(of, reps[some])], pa.bool_())],
                    ["rep", "keep_id", "group_size", "keeper"])

        for batch in slices(batches, BATCH_ROWS):
            kind = batch.schema.field("top").type
            for bucket, rep, key, rows, top, content in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from answers()
                    now = bucket
                    table, entries, reps, tops, keepers, sizes = ContentTable(), [], [], [], [], []
                entry = table.entry(key, content)
                if entry == len(tops):
                    tops.append(top)
                    keepers.append(rep)
                    sizes.append(0)
                elif top is not None and (tops[entry] is None or (top, -rep) > (tops[entry], -keepers[entry])):
                    tops[entry], keepers[entry] = top, rep
                sizes[entry] += rows
                entries.append(entry)
                reps.append(rep)
        yield from answers()

    kind = dealt.schema["top"].dataType.simpleString()
    columns = dealt.select("bucket", "rep", "key", "n_rows", "top", "content")
    place = F.pmod("bucket", F.lit(partitions)).cast("int")
    return (columns.repartitionById(partitions, place).sortWithinPartitions("bucket")
            .mapInArrow(resolve, f"rep long, keep_id {kind}, group_size long, keeper boolean"))


def _measured(records: DataFrame, *by: str) -> DataFrame:
    """Bytes and number of the different contents that a table has to hold."""
    once = records.groupBy(*by, "key").agg(F.max("n_bytes").alias("n_bytes"))
    return once.groupBy(*by).agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("held"), F.count("*").alias("keys"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET_BYTES,
                     limit: int = LIMIT_BYTES, held: int = HELD_BYTES,
                     key_of: Callable[[bytes], int] = content_hash) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    records = stored(collapsed(docs, id_col, text_col, key_of, held))
    pending, level, answers = records, 0, []
    while True:
        total = _measured(pending).first()["held"]
        buckets = max(2 if level else 1, -(-total // target))
        dealt = pending.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(buckets)))
        # a single hash cannot be dealt any further; its bucket holds one content unless hashes collide
        large = stored(_measured(dealt, "bucket").where(f"held > {limit} and keys > 1").select("bucket"))
        spilled = not large.isEmpty()
        fitting = dealt.join(large, "bucket", "left_anti") if spilled else dealt
        answers.append(resolved(fitting, min(buckets, FAN_OUT)))
        if not spilled:
            break
        pending, level = stored(dealt.join(large, "bucket", "left_semi").drop("bucket")), level + 1
    answer = answers[0]
    for more in answers[1:]:
        answer = answer.unionByName(more)
    members = records.select("rep", "ids", "sha", "top_at").join(answer, "rep")
    rows = members.select(F.posexplode("ids").alias("at", "member"), "keep_id", "group_size", "keeper", "top_at", "sha")
    return rows.select(F.col("member").alias(id_col), "keep_id", "group_size",
                       (F.col("keeper") & (F.col("at") == F.col("top_at"))).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))
