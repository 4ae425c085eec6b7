"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are shape statistics of the line and of its neighbours. The chain is fitted on a
bounded sample of labelled documents, all lines of each, which carry the document's label. A document's score is a logistic
function of its lines' forward-backward marginals, weighted by length, fitted on the same sample. Where the sample has more
than DRIVER_LINES lines, executors sum up the gradients.

Defined results: texts without a word (null ones too) score as the share of label 1; repeated rows score alike; without
usable labels all scores are equal; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize
from .labelled import MAX_FIT, adam, sigmoid, training_texts
from .textkernel import texts, word_hashes, words

THRESHOLD = 0.7
#: Lines of one document that are fitted as one chain; longer documents give as many chains as they need.
CHAIN, STEPS, RIDGE = 64, 120, 1e-4
#: Lines in a stored piece of a document (whole chains), and lines of the sample up to which the driver alone fits.
PIECE, DRIVER_LINES = 16 * CHAIN, 200_000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[*chars.encode()]] = 1
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_LETTER = _UPPER + _table("abcdefghijklmnopqrstuvwxyz") + (np.arange(256) >= 128)
_SYMBOL, _BAR, _SHOUT = _table("#$%&*@^~_+=<>{}[]\\/"), _table("|"), _table("!?")
_STOP = _table(".,;:")


def lines(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with a word, its length in bytes, and the number of such lines before each document."""
    starts, ends, _ = words(b, off)
    if not len(starts):
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(len(off), np.int64)
    breaks = np.union1d(np.flatnonzero(b == 10), off[1:-1])
    line_of = np.searchsorted(breaks, starts, side="right")
    head = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]]))  # first word of each line
    count = np.diff(np.concatenate([head, [len(starts)]])).astype(float)
    begin, finish = starts[head], ends[np.concatenate([head[1:], [len(starts)]]) - 1]
    size = (finish - begin).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[b])])
        return (sums[finish] - sums[begin]) / size

    h = word_hashes(b, starts, ends)

    def repeated(gap: int) -> np.ndarray:
        same = np.zeros(len(h))
        same[gap:] = (h[gap:] == h[:-gap]) & (line_of[gap:] == line_of[:-gap])
        return np.add.reduceat(same, head) / count

    letters, last = share(_LETTER), b[ends - 1]
    plain = [
        share(_UPPER) / np.maximum(letters, 0.01),
        share(_DIGIT),
        np.minimum(share(_SYMBOL) * 4, 1),
        np.minimum(share(_BAR) * 6, 1),
        np.minimum(share(_SHOUT) * 6, 1),
        share(_STOP) * 4,
        1 - letters,
        np.minimum(np.add.reduceat((ends - starts).astype(float), head) / count / 10, 3),
        np.log1p(count) / 4,
        np.add.reduceat(_SYMBOL[last], head) / count,
        np.add.reduceat(((ends - starts) == 1) * 1.0, head) / count,
        repeated(1),
        repeated(2) + repeated(3),
        (count < 4) * 1.0,
        _UPPER[b[begin]],
        _STOP[b[finish - 1]] + _SHOUT[b[finish - 1]],
    ]
    own = np.stack(plain, axis=1)
    doc = np.searchsorted(off, begin, side="right") - 1
    before, after = np.zeros_like(own), np.zeros_like(own)  # neighbouring lines of the same document
    joined = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * joined, own[1:] * joined
    edge = np.ones((len(own), 3))
    edge[1:, 1], edge[:-1, 2] = joined[:, 0] == 0, joined[:, 0] == 0
    return np.concatenate([own, before, after, edge], axis=1), size, np.searchsorted(doc, np.arange(len(off)))


N_FEATURES = 16 * 3 + 3


def forward_backward(unary: np.ndarray, first: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for every line of every chain, and expected counts of turns.

    unary: log-odds of label 1; first: lines before each chain; turn: 2 x 2 log-weights from label to label.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n, e = first[:-1][order], n[order], np.exp(turn)
    total, longest = int(first[-1]), int(n[0]) if len(n) else 0
    forward, backward = np.zeros((total, 2)), np.ones((total, 2))
    node = np.stack([1 - sigmoid(unary), sigmoid(unary)], axis=1)
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = start[: live[t]] + t
        x = node[at] if not t else (forward[at - 1] @ e) * node[at]
        forward[at] = x / x.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        x = (node[at + 1] * backward[at + 1]) @ e.T
        backward[at] = x / x.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
    inner = np.ones(total, dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    k = np.flatnonzero(inner)
    pair = forward[k - 1][:, :, None] * e[None] * (node[k] * backward[k])[:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
    return both[:, 1], pair.sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    turn: np.ndarray
    slope: float
    offset: float
    share: float

    def means(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' chances to be good; not a number for texts without words."""
        x, size, first = lines(b, off)
        good, _ = forward_backward(x @ self.weights, first, self.turn)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, good * size, len(off) - 1) / np.bincount(doc, size, len(off) - 1)

    def scores(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        mean = self.means(b, off)
        return np.where(np.isnan(mean), self.share, sigmoid(self.slope * (np.nan_to_num(mean) - 0.5) + self.offset))


def chain_sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Unscaled gradient of the chains' loss at p (weights and turns) over pieces of n lines and label y each."""
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    first = np.append(np.flatnonzero(place % CHAIN == 0), len(piece))
    gold, inner = y[piece], place % CHAIN != 0
    turns = np.array([[(inner & (gold == 0)).sum(), 0], [0, (inner & (gold == 1)).sum()]], float)
    good, pairs = forward_backward(x @ p[:-4], first, p[-4:].reshape(2, 2))
    return np.concatenate([x.T @ (good - gold), (pairs - turns).ravel()])


def _pieces(batch: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and numbers of lines of stored pieces."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    return x, batch.column("y").to_numpy().astype(float), batch.column("n").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_fit: int = MAX_FIT // 2) -> Model:
    train = training_texts(docs, labels, label, held_out, max_fit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, b, off in texts(batch.column(0)):
                x, _, first = lines(b, off)
                for k in range(j - i):
                    cuts = [*range(first[k], first[k + 1], PIECE), first[k + 1]]
                    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([int(y[i + k])] * len(parts), pa.int32()), pa.array([x[a:z].astype(np.float32).tobytes() for a, z in parts], pa.binary()), pa.array([z - a for a, z in parts], pa.int32())], ["y", "x", "n"])

    own = train.agg(F.avg("y").alias("share")).first()["share"]
    share = 0.5 if own is None else float(own)
    if own is None or share in (0.0, 1.0):
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), share)
    stored = materialize(train.mapInArrow(measure, "y int, x binary, n int"))
    inner = F.col("n") - F.ceil(F.col("n") / CHAIN)  # every piece starts a chain
    total, turns = (int(v or 0) for v in stored.agg(F.sum("n"), F.sum(inner)).first())
    if total <= DRIVER_LINES:
        pieces = _pieces(stored.toArrow())
        sums = lambda p: chain_sums(*pieces, p)
    else:

        def sums(p: np.ndarray) -> np.ndarray:
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(0, batch.num_rows, 64):  # a piece has PIECE lines at most
                        yield pa.RecordBatch.from_arrays([pa.array([chain_sums(*_pieces(batch.slice(k, 64)), p).tobytes()], pa.binary())], ["g"])

            found = stored.mapInArrow(part, "g binary").toArrow()["g"].to_pylist()  # a few numbers for each 64 pieces
            return np.sum([np.frombuffer(g, np.float64) for g in found], axis=0)

    def gradient(p: np.ndarray) -> np.ndarray:
        g = sums(p)
        return np.concatenate([g[:-4] / max(1, total) + RIDGE * p[:-4], g[-4:] / max(1, turns) + 1e-2 * p[-4:]])

    p = adam(gradient, np.zeros(N_FEATURES + 4), STEPS, 0.15) if total else np.zeros(N_FEATURES + 4)
    model = Model(p[:-4], p[-4:].reshape(2, 2), 1.0, 0.0, share)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = np.full(batch.num_rows, np.nan)
            for i, j, b, off in texts(batch.column(0)):
                means[i:j] = model.means(b, off)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(means)], ["y", "mean"])

    # two numbers for each text of the sample
    rows = train.mapInArrow(average, "y int, mean double").toArrow()
    mean = rows["mean"].to_numpy()
    has = ~np.isnan(mean)
    mean, own = mean[has], rows["y"].to_numpy().astype(float)[has]
    if not len(mean):
        return Model(model.weights, model.turn, 0.0, 0.0, share)

    def logistic(q: np.ndarray) -> np.ndarray:
        error = sigmoid(q[0] * (mean - 0.5) + q[1]) - own
        return np.array([(error * (mean - 0.5)).mean() + 1e-4 * q[0], error.mean()])

    model.slope, model.offset = map(float, adam(logistic, np.array([4.0, 0.0]), 400, 0.1))
    return model


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, label, fold(F.col("_id"), modulus) == held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, j, b, off in texts(batch.column(1)):
                scores[i:j] = model.scores(b, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", "predicted")
