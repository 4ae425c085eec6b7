"""Toxicity: a counterfactual-regularised linear classifier.

Features are the presence of words and of their beginnings and ends. Sums over a bounded sample of labelled rows pick the
features that tell the labels apart; a logistic model with a prior at shrunken log-odds is fitted on them. For each labelled
text that mentions an identity term, counterfactual copies swap the term for each other one of its set, the
neutral one included, and the squared change of the score is part of the loss: group mentions by themselves move no score.
A copy loses all features that only the term gave it, beginnings and ends included, and gets all of the other term's; none of
these features has a prior.

Defined results: texts without a letter or digit (null and empty ones too) score as the share of label 1; rows without identifier count as held out only if
their crc32 says so; repeated rows score alike; without usable labels all scores are 0; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, map_whole, materialize
from .labelled import MAX_FIT, adam, sigmoid, training_texts
from .textkernel import LOWER, MASKS, mix, texts, word_hashes

#: Sets of terms that a text's score must not hang on; the first of each is neutral.
IDENTITY = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("someone", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("folks", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("somebody", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("human", "black", "white", "asian", "african", "latino", "arab", "european", "american", "mexican", "chinese"),
    ("neighbor", "immigrant", "refugee", "foreigner", "native", "migrant"),
    ("resident", "disabled", "deaf", "blind", "old", "young", "elderly"),
)
THRESHOLD, MAX_FEATURES, MIN_COUNT = 0.7, 2048, 3
#: Weight of squared score changes, of the distance to the prior, and the prior's share of the log-odds.
SWAP_WEIGHT, RIDGE, SHRINK = 1.0, 0.02, 0.3
#: Smoothing of counts in the prior.
SMOOTH = 2
_PART = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def fold_case(b: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the Latin-1 capitals in UTF-8."""
    out = LOWER[b]
    capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    out[capital] += 32
    return out


def word_parts(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of runs of letters and digits, and the document of each."""
    b = fold_case(b)
    edge = np.zeros(len(b) + 2, dtype=bool)
    edge[1:-1] = _PART[b]
    starts, ends = edge[1:-1] & ~edge[:-2], edge[1:-1] & ~edge[2:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(b))]
    starts[inner], ends[inner - 1] = edge[1:-1][inner], edge[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return b, starts, ends, np.searchsorted(off, starts, side="right") - 1


def features(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, documents) of words, beginnings of 4 to 8 bytes, and ends of 4 to 6."""
    if not len(b):
        return
    b, starts, ends, doc = word_parts(b, off)
    yield word_hashes(b, starts, ends), doc
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    for shape, sizes in ((1, (4, 5, 6, 7, 8)), (2, (4, 5, 6))):
        for k in sizes:
            fits = ends - starts >= k
            at = starts[fits] if shape == 1 else ends[fits] - k
            yield mix(eight[at] & MASKS[k] ^ np.uint64((shape << 8 | k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), doc[fits]


def term_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


def term_features() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of all features of identity terms, which of them each term has, and the place of each term's whole word."""
    words = [t for group in IDENTITY for t in group]
    own = [np.concatenate([h for h, _ in features(b, np.array([0, len(b)]))]) for b in (np.frombuffer(w.encode(), np.uint8) for w in words)]
    keys = np.unique(np.concatenate(own))
    return keys, np.stack([np.isin(keys, h) for h in own]), np.searchsorted(keys, np.array([term_hash(w) for w in words], np.uint64))


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the features
    weights: np.ndarray
    bias: float
    share: float = 0.5  # of label 1 in the sample

    def scores(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, which = self.present(b, off)
        out = sigmoid(self.bias + np.bincount(doc, self.weights[which], len(off) - 1) if len(doc) else np.full(len(off) - 1, self.bias))
        letters = np.concatenate([[0], np.cumsum(_PART[b])])
        return np.where(letters[off[1:]] > letters[off[:-1]], out, self.share)

    def present(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of document and feature."""
        quick = np.zeros(1 << 20, dtype=bool)
        quick[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        pairs = [np.zeros(0, np.int64)]
        for h, doc in features(b, off):
            maybe = quick[(h >> np.uint64(44)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            if len(h) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                pairs.append(np.unique(doc[hit] * len(self.keys) + at[hit]))
        pairs = np.unique(np.concatenate(pairs))
        return pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys))


def swapped(b: np.ndarray, off: np.ndarray, keys: np.ndarray, has: np.ndarray, whole: np.ndarray) -> Iterator[np.ndarray]:
    """Changes of the term features (-1 goes, 1 comes), one line per counterfactual copy of each document.

    keys, has, whole: as from term_features().
    """
    counts = np.zeros((len(off) - 1, len(keys)), np.int32)
    for h, doc in features(b, off):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        np.add.at(counts, (doc[hit], at[hit]), 1)
    start = 0
    for group in IDENTITY:
        own = range(start, start + len(group))
        start += len(group)
        for a in own:
            docs = np.flatnonzero(counts[:, whole[a]])
            if not len(docs):
                continue
            kept = counts[docs] - counts[docs, whole[a]][:, None] * has[a] > 0  # what other words of the text give too
            for to in own:
                if to != a:
                    yield (has[to] & ~kept).astype(np.int8) - (has[a] & ~kept).astype(np.int8)


def swap_slope(w: np.ndarray, line: np.ndarray, moved: np.ndarray, sign: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Slope at w of the squared score changes of all swaps, each weighed by its strength.

    line, moved, sign: which swap moves which feature in which direction.
    """
    moves = 2 * strength * np.bincount(line, sign * w[moved], len(strength))
    return np.bincount(moved, sign * moves[line], len(w))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of texts of label 1 and 0 that have each feature."""
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, _, b, off in texts(batch.column(0)):
            for h, doc in features(b, off):
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, own = h[fresh], y[i + doc[fresh]]
                if len(h):
                    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    one, all_ = np.add.reduceat(own, at), np.diff(np.concatenate([at, [len(h)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(one), pa.array(all_ - one)], ["key", "one", "zero"])


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_fit: int = MAX_FIT) -> Model:
    train = training_texts(docs, labels, label, held_out, max_fit)
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    one, zero = totals.get(1, 0), totals.get(0, 0)
    if not one or not zero:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if one else -40.0, 1.0 if one else 0.0)
    counts = materialize(train.mapInArrow(_count, "key long, one long, zero long").groupBy("key").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).where(F.col("one") + F.col("zero") >= MIN_COUNT))
    # likelihood ratio of a feature against the label
    rate = (F.col("one") + F.col("zero")) / (one + zero)
    part = lambda n, total: F.when(n > 0, n * F.log(n / (total * rate))).otherwise(0.0)
    rest = lambda n, total: F.when(total - n > 0, (total - n) * F.log((total - n) / (total * (1 - rate)))).otherwise(0.0)
    evidence = 2 * (part(F.col("one"), one) + rest(F.col("one"), one) + part(F.col("zero"), zero) + rest(F.col("zero"), zero))
    # many features are tried, so one must show more than chance would for the best of them
    enough = 1.6 * math.log(max(2, counts.count())) + 1
    term_keys, has, whole = term_features()
    terms = term_keys[whole].view(np.int64).tolist()
    chosen = counts.withColumn("evidence", evidence).where((F.col("evidence") > enough) & (rate < 1)).orderBy(F.desc("evidence"), "key").limit(MAX_FEATURES).select("key", "one", "zero")
    found = chosen.unionByName(counts.where(F.col("key").isin(terms)).select("key", "one", "zero")).distinct().toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, with_one, with_zero = keys[order], found["one"].to_numpy()[order], found["zero"].to_numpy()[order]
    prior = SHRINK * (np.log((with_one + SMOOTH) / (one + 2 * SMOOTH)) - np.log((with_zero + SMOOTH) / (zero + 2 * SMOOTH)))
    prior[np.isin(keys, term_keys)] = 0
    model = Model(keys, prior, float(np.log(one / zero)), one / (one + zero))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, b, off in texts(batch.column(0)):
                doc, which = model.present(b, off)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                own = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(which.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(y[i:j].astype(np.int32)), own], ["y", "which"])

    rows = train.mapInArrow(pick, "y int, which array<int>").toArrow()  # at most the sample, a few numbers each
    y = rows["y"].to_numpy().astype(float)
    lists = rows["which"].combine_chunks()
    which = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    used = np.isin(term_keys, keys)  # the others have no weight

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, off in texts(batch.column(0)):
                found: dict[bytes, int] = {}
                for change in swapped(b, off, term_keys, has, whole):
                    for line, times in zip(*np.unique(change[:, used], axis=0, return_counts=True), strict=True):
                        if line.any():
                            found[line.tobytes()] = found.get(line.tobytes(), 0) + int(times)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["change", "n"])

    # one line per kind of swap that the labelled texts allow, with their number
    swaps = train.mapInArrow(swap, "change binary, n long").groupBy("change").agg(F.sum("n").alias("n")).toArrow()
    change = np.frombuffer(b"".join(swaps["change"].to_pylist()), np.int8).reshape(swaps.num_rows, -1) if swaps.num_rows else np.zeros((0, 0), np.int8)
    line, at = np.nonzero(change)
    sign, moved = change[line, at].astype(float), np.searchsorted(keys, term_keys[used])[at]
    strength = SWAP_WEIGHT * swaps["n"].to_numpy().astype(float)

    def slope(x: np.ndarray) -> np.ndarray:
        w, bias = x[:-1], x[-1]
        error = sigmoid(bias + np.bincount(row, w[which], len(y))) - y
        g = np.bincount(which, error[row], len(w)) + RIDGE * len(y) / 100 * (w - prior)
        if len(line):
            g += swap_slope(w, line, moved, sign, strength)
        return np.append(g, error.sum()) / len(y)

    x = adam(slope, np.append(prior, model.bias), 300, 0.05)
    return Model(keys, x[:-1], float(x[-1]), one / (one + zero))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' doc_id with score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, j, b, off in texts(batch.column(1)):
                scores[i:j] = model.scores(b, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, label, fold(F.col("_id"), modulus) == held)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD, source: DataFrame | None = None) -> DataFrame:
    """docs without the rows that score at the threshold or above; all columns stay. source: the labelled texts, if not docs."""
    model = fit(docs if source is None else source, labels, "toxic", fold(F.col("_id"), modulus) == held)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, j, b, off in texts(batch.column(at)):
                keep[i:j] = model.scores(b, off) < threshold
            yield batch.filter(pa.array(keep))

    return map_whole(docs, run, docs.schema)
