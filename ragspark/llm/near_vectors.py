"""Near-duplicate vectors through a robust-pruned flat graph.

Equal vectors count once, with their number. Centroids, fitted on a bounded sample, cut the rest into shards; every
vector belongs to the shards of its ``OVERLAP`` nearest centroids. In each shard a pruned neighbour graph is built: from
close and a few far candidates a node keeps a neighbour only if no kept one is ``ALPHA`` times closer to it; edges go
both ways. The adjacency lists of all shards are united. The search runs per shard on its part of the united graph:
a greedy beam search from the medoid (and from the query's own neighbours) finds the surroundings of each vector, then
the range expands through every vector at or above the threshold until nothing new appears. Similarities are double
precision cosines, so what is found is verified. A pair that meets in several shards counts in the first of them only.

A shard with more than ``PART_ROWS`` vectors is cut into parts by a hash; each part has its own graph and is searched by
all vectors of the shard, so nothing is capped. ``audit`` compares a bounded number of vectors with all others.

Vectors of different lengths never meet: every length has centroids, shards and an audit of its own, and lengths that the sample
lacks have one shard. Null and zero vectors, and vectors with null or non-finite components, link with nothing. Copies link with each other. Repeated rows count as copies; a null id takes part, and names no component. Extra
columns are not read. Ties cannot matter, as links depend on the threshold alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import slices, stored
from ragspark.llm.components import components

THRESHOLD = 0.9
SAMPLE = 20_000
SHARD_ROWS = 1_000
MOST_CENTROIDS = 2_048
OVERLAP = 4
PART_ROWS = 4_000
CANDIDATES, FAR, DEGREE, ALPHA = 48, 8, 16, 1.2
BEAM = 32
QUERY_ROWS = 256
#: What a task holds besides its part: rows of similarities, numbers of gathered vectors, cells of a step of the search.
GRAPH_ROWS, HELD_VALUES, CELLS = 512, 1 << 21, 1 << 18


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a finite vector that is not zero, and their vectors in double precision."""
    rows, vectors = [], []
    for i, values in enumerate(batch.column(1).to_pylist()):
        if values and None not in values:
            vector = np.array(values, dtype=np.float64)
            if np.isfinite(vector).all() and vector.any():
                rows.append(i)
                vectors.append(vector + 0.0)
    return np.array(rows, dtype=np.int64), vectors


def unit(vector: np.ndarray) -> np.ndarray:
    scaled = vector / np.abs(vector).max()
    return scaled / np.linalg.norm(scaled)


def matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def by_width(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    places: dict[int, list[int]] = {}
    for i, data in enumerate(raw):
        places.setdefault(len(data), []).append(i)
    return [(np.array(at), matrix([raw[i] for i in at])) for _, at in sorted(places.items())]


def distinct_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All ids with the node of their vector (null if it has none), and the nodes with copies and unit vectors."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in slices(batches, 5000):
            rows, vectors = usable(batch)
            nodes, data = [None] * batch.num_rows, [None] * batch.num_rows
            for i, v in zip(rows.tolist(), vectors):
                nodes[i] = xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63)
                data[i] = unit(v).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["id", "node", "data"])

    rows = stored(table.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(
        keyed, "id long, node long, data binary"))
    named = rows.select("id", "node")
    groups = named.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    nodes = stored(rows.where("node is not null").select("node", "data").dropDuplicates(["node"]).join(groups, "node"))
    return named, nodes


def centroids(sample: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the bounded sample."""
    centres = sample[np.linspace(0, len(sample) - 1, number).astype(int)]
    for _ in range(rounds):
        owner = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def memberships(nodes: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """Nodes with the sorted list of their shards; ``centres`` has a matrix for each length of vectors."""
    first = dict(zip([c.shape[1] for c in centres], np.cumsum([0, *map(len, centres)]).tolist()))
    of_width, beyond = {c.shape[1]: c for c in centres}, sum(map(len, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            listed: list = [None] * batch.num_rows
            for places, vectors in by_width(batch.column(1).to_pylist()):
                width = vectors.shape[1]
                if width in of_width:
                    k = min(OVERLAP, len(of_width[width]))
                    near = vectors @ of_width[width].T
                    shards = first[width] + np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
                else:
                    shards = np.full((len(places), 1), beyond + width)
                for place, some in zip(places.tolist(), shards.astype(np.int32).tolist()):
                    listed[place] = some
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, pa.list_(pa.int32()))],
                                             ["node", "data", "copies", "shards"])

    return nodes.select("node", "data", "copies").mapInArrow(assign, "node long, data binary, copies long, shards array<int>")


def pruned_graph(vectors: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Neighbour lists of one shard, pruned and made symmetric. Similarities are held for a bounded number of rows at a time."""
    n = len(vectors)
    if n < 2:
        return [np.empty(0, np.int64)] * n
    close = min(CANDIDATES, n - 1)
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    size = max(1, min(GRAPH_ROWS, HELD_VALUES // ((close + FAR) * vectors.shape[1])))
    left, right = [], []
    for start in range(0, n, size):
        own = np.arange(start, min(start + size, n))
        rows = np.arange(len(own))
        near = vectors[own] @ vectors.T
        near[rows, own] = -2
        candidates = np.hstack([np.argpartition(-near, close - 1, axis=1)[:, :close], far[own]])
        away = np.where(candidates == own[:, None], np.inf, np.sqrt(np.maximum(0, 2 - 2 * near[rows[:, None], candidates])))
        order = np.argsort(away, axis=1, kind="stable")
        candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
        there = vectors[candidates]
        between = np.sqrt(np.maximum(0, 2 - 2 * (there @ there.transpose(0, 2, 1))))
        between[candidates[:, :, None] == candidates[:, None, :]] = 0
        alive = np.isfinite(away)
        for _ in range(DEGREE):
            going = alive.any(1)
            if not going.any():
                break
            first = alive.argmax(1)
            left.append(own[going])
            right.append(candidates[rows, first][going])
            alive &= ALPHA * between[rows, first] > away
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.r_[a * n + b, b * n + a])
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(0)).argmax())


class Links:
    """The neighbour lists of one shard part as flat arrays, both ways round."""

    def __init__(self, sources: np.ndarray, targets: np.ndarray, n: int):
        """``sources`` ascends."""
        self.targets, self.degree = targets, np.bincount(sources, minlength=n)
        self.starts = np.cumsum(self.degree) - self.degree
        order = np.argsort(targets, kind="stable")
        self.sources = sources[order]
        self.reached, self.first = np.unique(targets[order], return_index=True)

    def of(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of neighbours of some vectors, and the neighbours one after the other."""
        degree = self.degree[where]
        return degree, self.targets[np.arange(degree.sum()) + np.repeat(self.starts[where] - np.cumsum(degree) + degree, degree)]

    def beyond(self, cells: np.ndarray) -> np.ndarray:
        """The (query, vector) cells next to the given ones: the queries are bits, so dense surroundings take no more memory."""
        q = len(cells)
        bits = np.packbits(cells, axis=0).T
        out = np.zeros((cells.shape[1], bits.shape[1]), np.uint8)
        if len(self.first):
            out[self.reached] = np.bitwise_or.reduceat(bits[self.sources], self.first, axis=0)
        return np.unpackbits(out, axis=1, count=q).T.astype(bool)


def in_range(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, graph: Links, start: int,
             threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs found at or above the threshold. ``own``: the query's place among the vectors, or -1."""
    q, n = len(queries), len(vectors)
    found = np.full((q, n), -2.0)
    expanded = np.zeros((q, n), bool)
    some = max(1, HELD_VALUES // vectors.shape[1])

    def see(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, vectors and similarities of new cells."""
        who, where, value = cells // n, cells % n, np.empty(len(cells))
        for a in range(0, len(cells), some):
            value[a:a + some] = np.einsum("ij,ij->i", queries[who[a:a + some]], vectors[where[a:a + some]])
        found[who, where] = value
        return who, where, value

    def look(who: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is new among the neighbours of ``where``, for the ascending queries ``who``, a bounded number at a time."""
        expanded[who, where] = True
        seen = [(who[:0], where[:0], np.empty(0))]
        total = np.cumsum(graph.degree[where])
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(total // CELLS)) + 1):
            degree, near = graph.of(where[part])
            asking = np.repeat(who[part], degree)
            new = found[asking, near] == -2.0
            seen.append(see(np.unique(asking[new] * n + near[new])))
        return tuple(np.concatenate(x) for x in zip(*seen))

    def spread(open_: np.ndarray) -> None:
        """As ``look`` for cells that have very many neighbours in all; similarities come as a product where most are new."""
        expanded[open_] = True
        new = graph.beyond(open_) & (found == -2.0)
        columns = np.flatnonzero(new.any(0))
        if 4 * np.count_nonzero(new) < q * len(columns):
            see(np.flatnonzero(new))
        else:
            for a in range(0, len(columns), some):
                there = columns[a:a + some]
                found[:, there] = np.where(new[:, there], queries @ vectors[there].T, found[:, there])

    member, width = np.flatnonzero(own >= 0), min(BEAM, n)
    best, at = np.full((q, width), -2.0), np.full((q, width), -1)
    who, where, value = see(np.unique(np.r_[np.arange(q) * n + start, member * n + own[member]]))
    for _ in range(4 * BEAM):  # the beam holds the best seen; its unexpanded members go next, all queries at once
        count = np.bincount(who, minlength=q)
        place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        more, more_at = np.full((q, count.max()), -2.0), np.full((q, count.max()), -1)
        more[who, place], more_at[who, place] = value, where
        best, at = np.hstack([best, more]), np.hstack([at, more_at])
        kept = np.argpartition(-best, width - 1, axis=1)[:, :width]
        best, at = np.take_along_axis(best, kept, 1), np.take_along_axis(at, kept, 1)
        open_ = ~np.take_along_axis(expanded, at, 1) & (best > -2)
        first = np.argsort(-np.where(open_, best, -3), axis=1)[:, :4]
        going = np.take_along_axis(open_, first, 1).ravel()
        if not going.any():
            break
        who, where, value = look(np.repeat(np.arange(q), first.shape[1])[going], np.take_along_axis(at, first, 1).ravel()[going])
    while True:
        open_ = (found >= threshold) & ~expanded
        if not open_.any():
            break
        who, where = np.nonzero(open_)
        if graph.degree[where].sum() > CELLS:
            spread(open_)
        else:
            look(who, where)
    return np.nonzero(found >= threshold)


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for batch in slices(batches, 1000):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def adjacency(members: DataFrame) -> DataFrame:
    """The united neighbour lists of all shards' graphs."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches, 2):
            nodes = np.array([r[2] for r in group], dtype=np.int64)
            lists = pruned_graph(matrix([r[3] for r in group]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array([nodes[x].tolist() for x in lists], pa.list_(pa.int64()))], ["node", "near"])

    dealt = members.select("shard", "part", "node", "data").repartition("shard", "part").sortWithinPartitions("shard", "part", "node")
    lists = dealt.mapInArrow(build, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def search(members: DataFrame, graph: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Per shard part and vector: the number of links found there, and its smallest connected node there."""
    targets = members.join(graph, "node", "left").select("shard", "part", F.lit(0).alias("role"), "node", "data", "copies",
                                                         "shards", "near")
    # vectors of other parts of the same shard come as queries only
    guests = members.join(parts.where("parts > 1"), "shard").select(
        "shard", "node", "data", "copies", "shards", F.col("part").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("part <> own")
    rows = targets.unionByName(guests.select(
        "shard", "part", F.lit(1).alias("role"), "node", "data", "copies", "shards",
        F.lit(None).cast("array<long>").alias("near")))
    dealt = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "role", "node")

    return dealt.mapInArrow(lambda batches: searched(batches, threshold), "node long, links long, joined long")


def searched(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Parts come one after the other, in each its own vectors before its guests, which are not held."""
    part, key = None, None
    for batch in slices(batches, 1000):
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(keys)]):
            if tuple(keys[a, :2].tolist()) != key:
                if part is not None:
                    yield part.own()
                key = tuple(keys[a, :2].tolist())
                part = Part(key[0], threshold)
            if keys[a, 2] == 0:
                part.add(batch.slice(a, b - a))
            else:
                yield part.guests(batch.slice(a, b - a))
    if part is not None:
        yield part.own()


def merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest places of connected vectors, after some more pairs."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


class Part:
    """One shard part: its vectors and their graph. Of what the searches find, only links and labels are kept."""

    def __init__(self, shard: int, threshold: float):
        self.shard, self.threshold, self.rows = shard, threshold, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows.select(["node", "data", "copies", "shards", "near"]))

    def _build(self) -> None:
        """The rows come by node, so neighbours are found by a binary search."""
        if self.rows is None:
            return
        self.nodes, self.vectors, self.copies, self.shards = self._unpacked(self.rows)
        sources, targets, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for rows in self.rows:
            near = rows.column("near")
            values = near.flatten().to_numpy()
            source = held + np.repeat(np.arange(len(near)), near.value_lengths().fill_null(0).to_numpy())
            place = np.minimum(np.searchsorted(self.nodes, values), len(self.nodes) - 1)
            here = self.nodes[place] == values
            sources.append(source[here])
            targets.append(place[here])
            held += len(near)
        self.graph = Links(np.concatenate(sources), np.concatenate(targets), held)
        self.label, self.start, self.rows = np.arange(held), medoid(self.vectors) if held else 0, None

    @staticmethod
    def _unpacked(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not rows:
            return np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1), np.int64)
        nodes, copies = (np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("node", "copies"))
        listed = [x for r in rows for x in r.column("shards").to_pylist()]
        longest = max(map(len, listed))
        shards = np.array([x + [-1 - i for i in range(longest - len(x))] for x in listed], dtype=np.int64)
        return nodes, np.concatenate([matrix(r.column("data").to_pylist()) for r in rows]), copies, shards

    def _found(self, vectors: np.ndarray, own: np.ndarray, shards: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For some queries at a time: the first one's place, the pairs found, but for a vector and itself, and the queries' links."""
        for a in range(0, len(vectors), QUERY_ROWS):
            asking = slice(a, a + QUERY_ROWS)
            who, where = in_range(vectors[asking], own[asking], self.vectors, self.graph, self.start, self.threshold)
            other = own[a + who] != where
            who, where = who[other], where[other]
            links = np.zeros(len(vectors[asking]), np.int64)
            for at in range(0, len(who), CELLS):
                x, y = who[at:at + CELLS], where[at:at + CELLS]
                # the pair belongs to the first shard that both have
                first = np.full(len(x), np.iinfo(np.int64).max)
                for mine in shards[a + x].T:
                    both = (self.shards[y] == mine[:, None]).any(1)
                    first[both] = np.minimum(first[both], mine[both])
                np.add.at(links, x[first == self.shard], self.copies[y[first == self.shard]])
            yield a, who, where, links

    def guests(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Vectors of other parts: what one of them finds is joined, and it hangs on the first of these."""
        self._build()
        nodes, vectors, _, shards = self._unpacked([rows])
        links, to = np.zeros(len(nodes), np.int64), nodes.copy()
        if len(self.nodes):
            for a, who, where, some in self._found(vectors, np.full(len(nodes), -1), shards):
                links[a:a + QUERY_ROWS] = some
                asking, first = np.unique(who, return_index=True)
                to[a + asking] = self.nodes[where[first]]
                self.label = merged(self.label, where, where[first][np.searchsorted(asking, who)])
        return self._result(nodes, links, to)

    def own(self) -> pa.RecordBatch:
        self._build()
        links = np.zeros(len(self.nodes), np.int64)
        for a, who, where, some in self._found(self.vectors, np.arange(len(self.nodes)), self.shards):
            links[a:a + QUERY_ROWS] = some
            self.label = merged(self.label, a + who, where)
        return self._result(self.nodes, links, self.nodes[self.label])

    @staticmethod
    def _result(nodes: np.ndarray, links: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(to)], ["node", "links", "joined"])


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                           vector_col: str = "embedding", audit_queries: int = 64) -> DataFrame:
    """Per row the id, ``n_links``, ``component_id``, ``kept``, and the ``audited_recall`` of the whole run."""
    named, nodes = distinct_vectors(table, id_col, vector_col)
    number = nodes.count()
    order = F.xxhash64("node")
    sample = [r["data"] for r in nodes.select("node", "data").orderBy(order, "node").limit(SAMPLE).collect()]
    shards = int(np.clip(-(-number // SHARD_ROWS), 1, MOST_CENTROIDS))
    centres = [centroids(part, min(len(part), max(1, -(-shards * len(part) // len(sample)))))
               for _, part in by_width([bytes(x) for x in sample])]
    wide = stored(memberships(nodes, centres))
    flat = wide.select("node", "data", "copies", "shards", F.explode("shards").alias("shard"))
    parts = stored(flat.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
    members = stored(flat.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "data", "copies", "shards"))
    graph = stored(adjacency(members))
    found = stored(search(members, graph, parts, threshold))
    edges = found.where("node <> joined").select(F.col("node").alias("a"), F.col("joined").alias("b"))
    joined = components(edges)
    of_node = nodes.select("node", "copies").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").join(
        joined, "node", "left").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"),
                                       F.coalesce("component", "node").alias("component"))
    of_node = stored(of_node)
    recall = audit(nodes, of_node, threshold, audit_queries)
    first = named.join(of_node, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(of_node.join(first, "component"), "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("n_links").isNull(), F.lit(True)).otherwise(F.col("id") == F.col("component_id")),
                   F.lit(False)).alias("kept"),
        F.lit(recall).alias("audited_recall"))


def audit(nodes: DataFrame, of_node: DataFrame, threshold: float, queries: int) -> float:
    """Share of the true links of a bounded number of vectors, by hash order, that the search found; 1 without links."""
    asked = nodes.join(of_node, "node").orderBy(F.xxhash64("node"), "node").limit(queries).select(
        "node", "data", "copies", "n_links").collect()
    if not asked:
        return 1.0
    wanted = {w.shape[1]: (at, w) for at, w in by_width([bytes(r["data"]) for r in asked])}
    queried = len(asked)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(queried, np.int64)
        for batch in slices(batches, 2000):
            copies = batch.column(1).to_numpy()
            for rows, vectors in by_width(batch.column(0).to_pylist()):
                if vectors.shape[1] in wanted:
                    at, asking = wanted[vectors.shape[1]]
                    total[at] += copies[rows] @ (vectors @ asking.T >= threshold)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(queried)), pa.array(total)], ["q", "n"])

    truth = nodes.select("data", "copies").mapInArrow(exact, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    links = {r["q"]: r["n"] - 1 for r in truth.collect()}
    true = sum(links.values())
    return 1.0 if not true else sum(min(r["n_links"], links[i]) for i, r in enumerate(asked)) / true


#: All pairs in DuckDB's SQL.
ORACLE = """
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
           and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
           and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
          where list_cosine_similarity(a.e, b.e) >= 0.9),
reached as (with recursive r(a, b) as (select vec_id, vec_id from v union select r.a, links.b from r join links on r.b = links.a)
            select a, min(b) as component from r group by 1)
select e.vec_id, count(l.b) as n_links, coalesce(any_value(component), e.vec_id) as component_id,
       coalesce(any_value(component), e.vec_id) = e.vec_id as kept
from embeddings e left join links l on l.a = e.vec_id left join reached c on c.a = e.vec_id group by e.vec_id
"""
