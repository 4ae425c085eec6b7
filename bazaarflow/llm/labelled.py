"""Training rows for the classifiers: a bounded sample of labels outside the held-out fold, with their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textkernel import mix, shingle_sets, texts

#: Labelled rows that a classifier is fitted on at most, about; a documented bound, not a limit of what is scored.
MAX_FIT = 20_000


def sample(rows: DataFrame, key: Column, most: int = MAX_FIT) -> DataFrame:
    """All rows, or about `most` of them, the same ones each time."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / total))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int = MAX_FIT) -> DataFrame:
    """text, y of sampled training rows. labels is cut to the bound first, so it can be broadcast whatever its size was.

    Of labels that repeat an identifier the largest counts; labels that are null or not 0 or 1 are left out.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out)
    own = sample(own.groupBy("_id").agg(F.max("y").alias("y")), F.col("_id"), most)
    return distinct_texts(docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("text", "y"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """text, y without rows that copy another's text or nearly so: copies would pass for independent evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros((2, batch.num_rows), np.uint64)
            for i, _, b, off in texts(batch.column(0)):
                s, first = shingle_sets(b, off)
                full = np.flatnonzero(np.diff(first))
                for k, x in enumerate((s, mix(s))):
                    marks[k, i + full] = np.minimum.reduceat(x, first[:-1][full]) if len(full) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m.view(np.int64)) for m in marks]], ["text", "y", "low", "other"])

    # one row for each of two minima of hashed shingles; the sample is bounded, and so are these shuffles
    rows = rows.mapInArrow(run, "text string, y int, low long, other long")
    for mark in ("low", "other"):
        rows = rows.groupBy(mark).agg(F.min_by(F.struct(*rows.columns), F.xxhash64("text")).alias("r")).select("r.*")
    return materialize(rows.select("text", "y"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise by Adam from x; gradient(x) gives the slope."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x
