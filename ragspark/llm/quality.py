"""A quality classifier for documents: a linear-chain conditional random field over their lines.

Every line has features of its characters and words and the means of its neighbours' features. The field has the two
states good and bad; a forward and a backward pass give each line its marginal, and the marginals, weighted by the
lines' lengths, are aggregated into features of the document, which a logistic curve turns into a score.

Labels exist for documents only, so training is in steps: a line takes its document's label; a first line model finds
lines of bad documents that look good, and they are relabelled; the field is trained on the result; the curve is fitted
on the documents. The training sample is bounded (``SAMPLE_DOCS`` documents of at most ``SAMPLE_LINES`` lines, by hash
order); scoring covers every document and its whole text.

Null and empty texts have no line; their marginal counts as 1/2, so they get a score of their own. Rows are scored one
by one, so repeated rows score alike; extra columns are not read; an empty table gives an empty result. Without any
usable label of either kind, every score is the prior of the labels there are (1/2 without labels).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import slices

BATCH_ROWS = 256
SAMPLE_DOCS = 4000
SAMPLE_LINES = 300
STEPS = 80
OWN = 14
PUNCTUATION = ".,;:?\"'()-…«»¿¡„“”’"


def _classes() -> np.ndarray:
    """A class for each code point below 0x2100: 0 other letter, 1 capital, 2 digit, 3 space, 4 punctuation, 5 '!', 6 '|', 7 symbol."""
    table = np.zeros(0x2100, np.uint8)
    for code in range(len(table)):
        c = chr(code)
        table[code] = (3 if c.isspace() else 4 if c in PUNCTUATION else 5 if c == "!" else 6 if c == "|"
                       else 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 7)
    return table


CLASS_OF = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths, and the number of such lines in each text."""
    kept, doc_lines = [], []
    seen_more: list[bool] = []
    for text in texts:
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        once: dict[str, int] = {}
        for x in lines:
            once[x] = once.get(x, 0) + 1
        seen_more += [once[x] > 1 for x in lines]
        kept += lines
        doc_lines.append(len(lines))
    n = len(kept)
    if not n:
        return np.empty((0, 2 * OWN)), np.empty(0), np.array(doc_lines, dtype=np.int64)
    lengths = np.fromiter(map(len, kept), dtype=np.int64, count=n)
    codes = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = CLASS_OF[np.where(codes < len(CLASS_OF), codes, 0)]
    starts = np.cumsum(lengths) - lengths
    share = {k: np.add.reduceat((kinds == k).astype(np.float32), starts) for k in range(8)}
    visible = np.maximum(lengths - share[3], 1)
    letters = np.maximum(share[0] + share[1], 1)
    words = [x.split() for x in kept]
    count = np.fromiter((max(1, len(w)) for w in words), dtype=np.float64, count=n)
    different = np.fromiter((len(set(w)) for w in words), dtype=np.float64, count=n)
    again = np.fromiter((sum(map(operator.eq, w, w[1:])) for w in words), dtype=np.float64, count=n)
    last = kinds[starts + lengths - 1]
    own = np.stack([
        share[1] / letters, share[7] / visible, np.minimum(1, share[6] / count), np.minimum(1, share[5] / count),
        share[4] / visible, share[2] / visible, again / count, different / count, np.minimum(2, visible / count / 10),
        np.log1p(count) / 5, last == 4, kinds[starts] == 1, np.array(seen_more), np.minimum(1, share[7] / count),
    ], axis=1).astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), doc_lines)
    same = np.append(owner[1:] == owner[:-1], False)
    around, number = np.zeros_like(own), np.zeros(n)
    at = np.flatnonzero(same)
    around[at] += own[at + 1]
    around[at + 1] += own[at]
    number[at] += 1
    number[at + 1] += 1
    around /= np.maximum(number, 1)[:, None]
    return np.hstack([own, around]), lengths.astype(np.float64), np.array(doc_lines, dtype=np.int64)


def _soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Chains:
    """Lines of many documents laid out so that one step of the recursion handles one line of every document."""

    def __init__(self, doc_lines: np.ndarray):
        self.n = doc_lines
        self.order = np.argsort(-doc_lines, kind="stable")
        sorted_lines = doc_lines[self.order]
        starts = (np.cumsum(doc_lines) - doc_lines)[self.order]
        longest = int(sorted_lines[0]) if len(sorted_lines) else 0
        active = np.searchsorted(-sorted_lines, -np.arange(1, longest + 1), side="right")
        self.steps = [starts[:k] + t for t, k in enumerate(active)]

    def passes(self, unary: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each line's forward message (its own score included) and of its backward message."""
        def message(x):  # what a neighbour with log-odds x says: log (e^(x+stay1) + 1) / (e^x + e^stay0)
            return _soft(x + stay[1]) - np.logaddexp(x, stay[0])
        ahead, back = unary.copy(), np.zeros_like(unary)
        for before, here in zip(self.steps, self.steps[1:]):
            ahead[here] += message(ahead[before[:len(here)]])
        for before, here in zip(self.steps[-2::-1], self.steps[:0:-1]):
            back[before[:len(here)]] = message(unary[here] + back[here])
        return ahead, back


@dataclass(frozen=True)
class Model:
    """Weights of the line features (bias last), the two bonuses for staying in a state, and the document curve."""

    weights: np.ndarray
    stay: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    curve: np.ndarray

    def marginals(self, features: np.ndarray, doc_lines: np.ndarray) -> np.ndarray:
        unary = ((features - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1]
        ahead, back = Chains(doc_lines).passes(unary, self.stay)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))

    def score(self, texts: list[str]) -> np.ndarray:
        features, lengths, doc_lines = line_features(texts)
        return curve_value(document_features(self.marginals(features, doc_lines), lengths, doc_lines), self.curve)


def document_features(good: np.ndarray, lengths: np.ndarray, doc_lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals and length-weighted share of lines more likely bad."""
    owner = np.repeat(np.arange(len(doc_lines)), doc_lines)
    total = np.bincount(owner, lengths, len(doc_lines))
    none = total == 0
    total[none] = 1
    mean = np.bincount(owner, lengths * good, len(doc_lines)) / total
    bad = np.bincount(owner, lengths * (good < 0.5), len(doc_lines)) / total
    mean[none], bad[none] = 0.5, 0.5
    return np.stack([mean, bad, np.ones(len(doc_lines))], axis=1)


def curve_value(features: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ curve, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def train(features: np.ndarray, lengths: np.ndarray, doc_lines: np.ndarray, labels: np.ndarray) -> Model:
    """Relabelling, gradient ascent on the field's likelihood, and the document curve, all over the bounded sample."""
    width = features.shape[1]
    if not len(labels) or labels.min() == labels.max():
        prior = float(labels.mean()) if len(labels) else 0.5
        odds = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return Model(np.zeros(width + 1), np.zeros(2), np.zeros(width), np.ones(width), np.array([0.0, 0.0, odds]))
    centre, scale = features.mean(0), features.std(0) + 1e-6
    x = np.hstack([(features - centre) / scale, np.ones((len(features), 1))])
    y = np.repeat(labels, doc_lines).astype(np.float64)
    first = 1 / (1 + np.exp(-np.clip(x @ _logistic(x, y), -30, 30)))
    y[(y == 0) & (first > 0.9)] = 1.0
    w, stay = _logistic(x, y), np.array([0.5, 0.5])
    chains = Chains(doc_lines)
    pairs = [(a[:len(b)], b) for a, b in zip(chains.steps, chains.steps[1:])]
    left = np.concatenate([a for a, _ in pairs]) if pairs else np.empty(0, np.int64)
    right = np.concatenate([b for _, b in pairs]) if pairs else np.empty(0, np.int64)
    seen = np.array([((y[left] == 0) & (y[right] == 0)).sum(), ((y[left] == 1) & (y[right] == 1)).sum()], dtype=float)
    state = np.append(w, stay)
    moment, spread = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        unary, stay = x @ state[:-2], state[-2:]
        ahead, back = chains.passes(unary, stay)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))
        a, b = ahead[left], unary[right] + back[right]
        table = np.stack([np.full_like(a, stay[0]), b, a, a + b + stay[1]])
        table = np.exp(table - table.max(0))
        table /= table.sum(0)
        slope = np.concatenate([x.T @ (y - p), seen - table[[0, 3]].sum(1)]) / len(x) - 1e-4 * state
        moment, spread = 0.9 * moment + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        state = state + 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    model = Model(state[:-2], state[-2:], centre, scale, np.zeros(3))
    shape = document_features(model.marginals(features, doc_lines), lengths, doc_lines)
    return Model(model.weights, model.stay, centre, scale, _logistic(shape, labels.astype(np.float64)))


def held_out(key: Column, folds: int = 5) -> Column:
    """True for rows whose label must not be learnt: CRC-32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on labelled documents outside the held-out fold; only line features of the bounded sample reach the driver."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            out: list[tuple] = []
            for text, label, place in zip(*(c.to_pylist() for c in batch.columns)):
                if (text or "").count("\n") >= SAMPLE_LINES:
                    continue
                features, lengths, _ = line_features([text or ""])
                if len(lengths):
                    out.append((place, label, features.astype(np.float32).tobytes(), lengths.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    ["place", "label", "features", "lengths"])

    known = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label")))
    # the sample is chosen among ids alone, so no text is shuffled for rows outside it; half of it for each label
    place = F.xxhash64(F.col(id_col).cast("string"))
    ids = docs.select(id_col).join(known, id_col).select(id_col, "_label", place.alias("_place"))
    halves = [ids.where(F.col("_label") == k).orderBy("_place", id_col).limit(sample_docs // 2) for k in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    shares = {r["_label"]: r["n"] for r in ids.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    rows = (docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "_label", "_place")
            .mapInArrow(sampled, "place long, label int, features binary, lengths binary").collect())
    rows.sort(key=lambda r: (r.place, r.label))
    features = [np.frombuffer(r.features, np.float32).reshape(-1, 2 * OWN) for r in rows]
    lengths = [np.frombuffer(r.lengths) for r in rows]
    labelled = np.array([r.label for r in rows], dtype=np.int64)
    model = train(np.concatenate(features).astype(np.float64) if rows else np.empty((0, 2 * OWN)),
                  np.concatenate(lengths) if rows else np.empty(0), np.array([len(x) for x in lengths], dtype=np.int64),
                  labelled)
    return _to_prior(model, labelled, shares)


def _to_prior(model: Model, labelled: np.ndarray, shares: dict[int, int]) -> Model:
    """The curve moved from the sample's balance of labels to that of all labels."""
    taken = np.bincount(labelled, minlength=2) if len(labelled) else np.zeros(2)
    if not taken.all() or not all(shares.get(k) for k in (0, 1)):
        return model
    move = np.log(shares[1] / shares[0]) - np.log(taken[1] / taken[0])
    return Model(model.weights, model.stay, model.centre, model.scale, model.curve + np.array([0, 0, move]))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row the id, whether it is held out, the score and the prediction (1 from ``threshold`` on)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            score = model.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(scored, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; each row is judged by its own text, whatever its id."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            score = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(kept, docs.schema)
