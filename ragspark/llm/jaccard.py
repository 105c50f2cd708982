"""N-gram Jaccard self-join with signature trees, and the components of its links.

A document's set holds the 64-bit hashes of its word shingles. Two sets link when ``100 * common >= least * union``.
The way to the trees loses no link:

1. Equal sets are one member from here on.
2. A set of n hashes shares at least ``o = ceil(least * n / 100)`` of them with a partner, with one of m hashes at least
   ``c = ceil(least * (n + m) / (100 + least))``. The ``p`` smallest hashes of every set, 30 % of it, are its sketch. The
   j-th smallest common hash is at most number ``j + n - c`` of the one set and ``j + m - c`` of the other, so the two
   sketches share at least the smaller of ``p_n - (n - c)`` and ``p_m - (m - c)``. Sketches are counted in hash buckets;
   sets that share less than the least of this over all sizes a partner can have (``least_matched``) have no partner.
   Then the same with whole sets, among the sets left.
3. Ordered from rare to frequent, the first ``n - o + 1`` hashes of two partners have one in common. Sets that meet
   there, directly or through others, are a family; only frequencies decide this, pairs are never listed.
4. Each set travels once to its family. There a signature tree groups the sets: a node holds the OR of its sets'
   bitmaps and the range of their sizes. A dual traversal compares node with node and drops pairs whose sizes cannot
   fit or whose largest possible overlap is too small. Pairs already connected are skipped, so a family of thousands of
   near copies costs about one comparison per member. A family with more hashes than a block may hold is cut into
   blocks, and every pair of blocks is a task of its own.

Nothing is dropped, capped or sampled. Null texts and texts without words have an empty set and link with nothing; rows
without an id take part but name no component (null if no member has an id). Repeated rows get equal results. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import WordHashes, lower_ascii, mixed, packed, runs, shipped, slices, stored, text_key, window_hashes, words_of
from ragspark.llm.components import components

WIDTH = 5
LEAST = 80
SKETCH = 30
BATCH_ROWS = 512
BLOCK_HASHES = 1_500_000
LEAF, FAN = 8, 8
FLUSH_BYTES = 24 << 20


def shingle_set(text: str | None, table: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of the shingles; with fewer words the whole sequence is one shingle."""
    words = words_of(lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = table.of(words)
    return np.unique(window_hashes(hashes, min(width, len(words))))


class SignatureTree:
    """Sets in an order that brings near copies together, in nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.order, self.sets = order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets])
        rows = np.repeat(np.arange(len(sets)), self.size)
        slots = (np.concatenate(self.sets) % np.uint64(bits)).astype(np.int64)
        flags = np.zeros((len(sets), bits), np.uint8)
        flags[rows, slots] = 1
        maps = np.packbits(flags, axis=1).view(np.uint64)
        excess = self.size - np.bitwise_count(maps).sum(axis=1)
        #: levels from the leaves up: bitmaps, smallest and largest size, most hashes that share a bit within one set
        self.maps, self.low, self.high, self.excess, self.edges = [], [], [], [], []
        edges = np.append(np.arange(0, len(sets), LEAF), len(sets))
        kept = (maps, self.size, self.size, excess)
        while True:
            at = edges[:-1] if not self.edges else np.arange(0, len(self.low[-1]), FAN)
            bottom = np.append(edges[:-1], len(sets)) if not self.edges else np.append(self.edges[-1][:-1][at], len(sets))
            self.maps.append(np.bitwise_or.reduceat(kept[0], at, axis=0))
            self.low.append(np.minimum.reduceat(kept[1], at))
            self.high.append(np.maximum.reduceat(kept[2], at))
            self.excess.append(np.maximum.reduceat(kept[3], at))
            self.edges.append(bottom)
            kept = (self.maps[-1], self.low[-1], self.high[-1], self.excess[-1])
            if len(at) == 1:
                break
        self.set_maps, self.set_excess = maps, excess

    @property
    def root(self) -> tuple[int, int]:
        return len(self.low) - 1, 0

    def members(self, node: tuple[int, int]) -> slice:
        level, i = node
        return slice(int(self.edges[level][i]), int(self.edges[level][i + 1]))

    def children(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        level, i = node
        return [(level - 1, k) for k in range(i * FAN, min((i + 1) * FAN, len(self.low[level - 1])))]


class TreeJoin:
    """The dual traversal over two trees (or one with itself); ``links`` connect what has not been connected before."""

    def __init__(self, left: SignatureTree, right: SignatureTree, least: int):
        self.left, self.right, self.least = left, right, least
        self.same = left is right
        n = len(left.sets)
        self.shift = 0 if self.same else n
        self.label = np.arange(n if self.same else n + len(right.sets))
        self.links: list[tuple[int, int]] = []
        self.compared = 0

    def run(self) -> list[tuple[int, int]]:
        if self.same:
            self._within(self.left.root)
        else:
            self._across(self.left.root, self.right.root)
        return self.links

    def _within(self, node: tuple[int, int]) -> None:
        if node[0] == 0:
            return self._leaves(node, node)
        below = self.left.children(node)
        for child in below:
            self._within(child)
        for i, a in enumerate(below):
            for b in below[i + 1:]:
                self._across(a, b)

    def _possible(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        (la, ia), (lb, ib), x, y = a, b, self.left, self.right
        if x.high[la][ia] * 100 < y.low[lb][ib] * self.least or y.high[lb][ib] * 100 < x.low[la][ia] * self.least:
            return False
        common = int(np.bitwise_count(x.maps[la][ia] & y.maps[lb][ib]).sum()) + min(x.excess[la][ia], y.excess[lb][ib])
        return common * (100 + self.least) >= self.least * (x.low[la][ia] + y.low[lb][ib])

    def _connected(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        first, second = self.left.members(a), self.right.members(b)
        one, two = self.label[first], self.label[second.start + self.shift:second.stop + self.shift]
        return one[0] == two[0] and (one == one[0]).all() and (two == two[0]).all()

    def _across(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if not self._possible(a, b) or self._connected(a, b):
            return
        if a[0] == 0 and b[0] == 0:
            return self._leaves(a, b)
        if a[0] >= b[0]:
            for child in self.left.children(a):
                self._across(child, b)
        else:
            for child in self.right.children(b):
                self._across(a, child)

    def _leaves(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        x, y = self.left, self.right
        for i in range(x.members(a).start, x.members(a).stop):
            start = i + 1 if self.same and a == b else y.members(b).start
            others = np.arange(start, y.members(b).stop)
            others = others[self.label[others + self.shift] != self.label[i]]
            if not len(others):
                continue
            least = -(-self.least * (x.size[i] + y.size[others]) // (100 + self.least))
            common = np.bitwise_count(x.set_maps[i] & y.set_maps[others]).sum(axis=1)
            common = np.minimum(common + np.minimum(x.set_excess[i], y.set_excess[others]), np.minimum(x.size[i], y.size[others]))
            for j, wanted in zip(others[common >= least].tolist(), least[common >= least].tolist()):
                if self.label[i] == self.label[j + self.shift]:
                    continue
                self.compared += 1
                if len(np.intersect1d(x.sets[i], y.sets[j], assume_unique=True)) >= wanted:
                    old, new = self.label[j + self.shift], self.label[i]
                    self.label[self.label == old] = new
                    self.links.append((x.order[i], y.order[j]))


def joined(sets: list[np.ndarray], others: list[np.ndarray] | None, least: int = LEAST) -> list[tuple[int, int]]:
    """Links (index, index) that connect whatever the join connects within ``sets``, or between both lists."""
    every = sets if others is None else sets + others
    mean = sum(map(len, every)) / max(1, len(every))
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * mean + 1)), 9, 16))
    left = SignatureTree(sets, bits)
    return TreeJoin(left, left if others is None else SignatureTree(others, bits), least).run()


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    return classes(docs, width, least, id_col, text_col).select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def unique_documents(docs: DataFrame, width: int = WIDTH, least: int = LEAST, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: of the smallest id, nulls last, and of its texts that with the smallest key.

    Rows are told apart by id and a 64-bit key of the text, so rows without an id and different texts of one id are judged alike. Of rows that
    share both, any one stays. Texts without words have no links and all stay. Only the rows that stay for several equal
    ones are shuffled for that; partial aggregation leaves one of them in each task.
    """
    key = "text_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    rows = docs.withColumn(key, text_key(F.col(text_col)))
    place = F.struct(F.col("doc").isNull(), "doc", "key")
    linked = stored(classes(docs, width, least, id_col, text_col).where("component is not null").groupBy(
        "component", "doc", "key").agg(F.count("*").alias("rows")))
    first = linked.groupBy("component").agg(F.min(place).alias("first"))
    judged = linked.join(first, "component").withColumn(
        "stays", F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.key") == F.col("key")))
    decided = stored(judged.where("not stays or rows > 1").select("doc", "key", "stays"))
    same = F.col("key").eqNullSafe(rows[key]) & F.col("doc").eqNullSafe(rows[id_col].cast("long"))
    left = rows.join(shipped(decided), same, "left_anti")
    several = decided.where("stays")
    if not several.isEmpty():
        left = left.unionByName(rows.join(shipped(several), same, "left_semi").dropDuplicates([id_col, text_col]))
    return left.drop(key)


def classes(docs: DataFrame, width: int = WIDTH, least: int = LEAST, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row ``doc``, the ``key`` of its text, ``n``, a name of its ``component`` and ``component_id``.

    ``component`` is null without words; ``component_id`` is null as well where no member has an id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        table, wanted = WordHashes(), {}
        for batch in slices(batches, BATCH_ROWS):
            sets = [shingle_set(t, table, width) for t in batch.column(2).to_pylist()]
            digests = [xxhash.xxh3_128(s.tobytes()).digest() for s in sets]
            wanted.update((n, least_matched(n, least)) for n in {len(s) for s in sets} - wanted.keys())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d.hex() if len(s) else None for s, d in zip(sets, digests)], pa.string()),
                 pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                 packed([s[:sketch_length(len(s), least)] for s in sets]), pa.array([wanted[len(s)] for s in sets], pa.int64())],
                ["doc", "key", "n", "set", "low", "sketch", "wanted"])

    every = stored(rows.mapInArrow(sketched, "doc long, key long, n long, set string, low long, sketch binary, wanted long"))
    # a member is named by the low half of its set's digest; the smallest row holds it
    members = stored(every.where("set is not null").groupBy("set", "low", "n", "wanted").agg(
        F.min("doc").alias("first_doc"), F.min(F.struct(F.col("doc").isNull(), "doc", "key")).alias("h")))
    matched = shared_counts(every.where("n > 0").select("low", F.col("sketch").alias("hashes")))
    eligible = stored(members.join(matched, "low").where("matched >= wanted").select("low", "n", "h.doc", "h.key"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in slices(batches, BATCH_ROWS):
            sets = [shingle_set(t, table, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(sets)], ["low", "n", "hashes"])

    same = rows["key"].eqNullSafe(eligible["key"]) & rows["doc"].eqNullSafe(eligible["doc"])
    sets = stored(rows.join(shipped(eligible), same).select("low", "n", "text").mapInArrow(whole, "low long, n long, hashes binary")
                  .dropDuplicates(["low"]))
    routes = stored(rare_prefixes(sets, least))
    anchors = routes.groupBy("hash").agg(F.min("low").alias("anchor"), F.count("*").alias("n")).where("n > 1").drop("n")
    meetings = routes.join(anchors, "hash").where("low <> anchor").select(
        F.col("low").alias("a"), F.col("anchor").alias("b")).distinct()
    families = stored(components(meetings))
    links = stored(family_links(sets, families, least))
    joined_up = components(links)
    named = members.join(joined_up, F.col("low") == F.col("node"), "left").select(
        "set", "first_doc", F.coalesce("component", "low").alias("component"))
    first = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_set = named.join(first, "component").select("set", "component", "component_id")
    return every.select("doc", "key", "n", "set").join(of_set, "set", "left").drop("set")


def sketch_length(n: int, least: int) -> int:
    overlap = -(-n * least // 100)
    return min(n, max(n - overlap + 1, -(-n * SKETCH // 100)))


def least_matched(n: int, least: int) -> int:
    """The smallest number of hashes that the sketch of a set of ``n`` shares with the sketch of any partner."""
    if n == 0:
        return 0
    m = np.arange(-(-n * least // 100), n * 100 // least + 1)
    common = -(-least * (n + m) // (100 + least))
    other = np.minimum(m, np.maximum(m + -m * least // 100 + 1, -(-m * SKETCH // 100)))
    return int(np.minimum(sketch_length(n, least) - (n - common), other - (m - common)).min())


def buckets(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def posting_blocks(sets: DataFrame) -> DataFrame:
    """(hash, member) postings in their hash bucket's partition, packed into one row for each flush and bucket.

    A flush holds many sets, so the number of rows follows the postings and not sets times buckets.
    """
    number = buckets(sets)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, names, held = [], [], 0
        for batch in slices(batches, 500):
            raw += batch.column(1).to_pylist()
            names.append(batch.column(0).to_numpy(zero_copy_only=False))
            held += batch.column(1).nbytes
            if held >= FLUSH_BYTES:
                yield cut(raw, names)
                raw, names, held = [], [], 0
        if raw:
            yield cut(raw, names)

    def cut(raw: list[bytes], names: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(raw), np.uint64)
        owners = np.repeat(np.concatenate(names), [len(r) // 8 for r in raw])
        return dealt_blocks((mixed(hashes) % np.uint64(number)).astype(np.int32), {"hashes": hashes, "names": owners})

    return sets.mapInArrow(block, "bucket int, hashes binary, names binary").repartition(number, "bucket")


def dealt_blocks(place: np.ndarray, columns: dict[str, np.ndarray], empty: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row for each bucket in ``place``, with the values of each column packed; ``empty`` columns hold none."""
    order = np.argsort(place, kind="stable")
    starts, sizes = runs(place[order])
    cut = [order[a:a + s] for a, s in zip(starts, sizes)]
    empty = empty or {}
    return pa.RecordBatch.from_arrays(
        [pa.array(place[order][starts], pa.int32()), *(packed([v[c] for c in cut]) for v in columns.values()),
         *(packed([v for _ in cut]) for v in empty.values())],
        ["bucket", *columns, *empty])


def unpacked(batches: Iterator[pa.RecordBatch], *kinds) -> list[np.ndarray]:
    """The packed columns of a whole partition, end to end."""
    parts: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i, part in enumerate(parts):
            part += batch.column(i + 1).to_pylist()
    return [np.frombuffer(b"".join(p), k) for p, k in zip(parts, kinds)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member, hash and frequency of every different posting of a partition whose hash two members have."""
    h, m = unpacked(batches, np.uint64, np.int64)
    order = np.lexsort((m, h))
    h, m = h[order], m[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])] if len(h) else np.empty(0, bool)
    h, m = h[new], m[new]
    _, sizes = runs(h)
    df = np.repeat(sizes, sizes)
    keep = df > 1
    return m[keep], h[keep], df[keep]


def shared_counts(sets: DataFrame) -> DataFrame:
    """``low`` and ``matched``: how many hashes of the member another member has too."""
    number = buckets(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, _ = _frequencies(batches)
        different, found = np.unique(names, return_counts=True)
        yield dealt_blocks(_home(different, number), {"names": different, "counts": found.astype(np.int64)})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = unpacked(batches, np.int64, np.int64)
        different, at = np.unique(names, return_inverse=True)
        found = np.bincount(at, counts, len(different)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(different, pa.int64()), pa.array(found)], ["low", "matched"])

    return (posting_blocks(sets).mapInArrow(count, "bucket int, names binary, counts binary").repartition(number, "bucket")
            .mapInArrow(total, "low long, matched long"))


def _home(names: np.ndarray, number: int) -> np.ndarray:
    return (mixed(names.view(np.uint64)) % np.uint64(number)).astype(np.int32)


def rare_prefixes(sets: DataFrame, least: int) -> DataFrame:
    """``hash`` and ``low``: of each set that can have a partner, the shared ones among its ``n - o + 1`` rarest hashes."""
    number = buckets(sets)

    def list_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, df = _frequencies(batches)
        none = np.empty(0, np.int64)
        yield dealt_blocks(_home(names, number), {"names": names, "hashes": hashes, "frequencies": df.astype(np.int32)},
                           {"members": none, "sizes": none})

    def list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = {"names": np.empty(0, np.int64), "hashes": np.empty(0, np.uint64), "frequencies": np.empty(0, np.int32)}
        for batch in batches:
            low, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out = dealt_blocks(_home(low, number), {"members": low, "sizes": n}, none)
            yield out.select(["bucket", "names", "hashes", "frequencies", "members", "sizes"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, df, members, n = unpacked(batches, np.int64, np.uint64, np.int32, np.int64, np.int64)
        order = np.lexsort((hashes, df, names))
        names, hashes = names[order], hashes[order]
        starts, shared = runs(names)
        by_name = np.argsort(members)
        size = n[by_name][np.searchsorted(members[by_name], names[starts])]
        first = (size + -size * least // 100 + 1) - (size - shared)
        keep = np.arange(len(names)) - np.repeat(starts, shared) < np.repeat(first, shared)
        names, hashes = names[keep], hashes[keep].view(np.int64)
        for a in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a:a + 100_000]), pa.array(names[a:a + 100_000])], ["hash", "low"])

    # a member's size goes to the bucket where its shared hashes meet, so no join moves those hashes again
    shape = "bucket int, names binary, hashes binary, frequencies binary, members binary, sizes binary"
    listed = posting_blocks(sets.select("low", "hashes")).mapInArrow(list_shared, shape)
    sizes = sets.select("low", "n").mapInArrow(list_sizes, shape)
    return listed.unionByName(sizes).repartition(number, "bucket").mapInArrow(choose, "hash long, low long")


def family_links(sets: DataFrame, families: DataFrame, least: int, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Links ``a``, ``b`` between members: within each family, or each pair of blocks of a large one."""
    placed = sets.select("low", "n").join(families.select(F.col("node").alias("low"), F.col("component").alias("family")), "low")
    blocks = placed.groupBy("family").agg(F.ceil(F.sum("n") / block_hashes).cast("int").alias("blocks"))
    # the way of each member is settled on narrow rows, so the sets themselves move once
    ways = stored(placed.join(blocks, "family").select("low", "family", "blocks"))
    own = F.pmod(F.xxhash64("low"), F.col("blocks")).cast("int")
    dealt = sets.select("low", "hashes").join(shipped(ways), "low").select(
        "family", "low", "hashes", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("family", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "low", "hashes")
    dealt = dealt.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "own", "low")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in slices(batches, 1000):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    out += _group_links(group, least)
                    group = []
                group.append(row)
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if group:
            out += _group_links(group, least)
        if out:
            yield _link_batch(out)

    return dealt.mapInArrow(link, "a long, b long")


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def _group_links(group: list[tuple], least: int) -> list[tuple[int, int]]:
    _, one, two = group[0][:3]
    sides = [[(r[4], np.frombuffer(r[5], np.uint64)) for r in group if r[3] == k] for k in dict.fromkeys((one, two))]
    if not all(sides):
        return []
    left, right = sides[0], sides[-1]
    found = joined([s for _, s in left], None if one == two else [s for _, s in right], least)
    return [(left[i][0], right[j][0]) for i, j in found]
