"""Connected components of a graph of links.

Rounds of contraction, each written to the shared folder, replace every node by its smallest neighbour until at most
FINISH links are left; those, a bounded number, are united in one task. Labels are then carried back round by round.

Defined results: links of a node to itself and repeated links are ignored; a link with a null end counts as none; without links
there are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task unites at most: 16 bytes each.
FINISH = 1_000_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest label by repeated propagation and pointer jumping over arrays."""
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not columns:
        return
    a, b = (np.concatenate(x) for x in zip(*columns, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[i] == label[j]).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["id", "label"])


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """id, label for every end of edges (a, b): label is the smallest id of the component. Nothing is collected."""
    ordered = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, rounds, spent = materialize(ordered(edges)), [], []
    while left.count() > finish:
        near = left.select("a", "b").union(left.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        step = near.select("id", F.least("id", "near").alias("label"))
        onward = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(onward, "label", "left").select("id", F.coalesce("further", "label").alias("label")))
        rounds.append(step)
        spent.append(left)
        start, end = (step.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label")) for k in ("a", "b"))
        left = materialize(ordered(left.join(start, "a").join(end, "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))))
    labels = materialize(left.repartition(1).mapInArrow(_unite, "id long, label long"))
    for step in reversed(rounds):
        last = labels.select(F.col("id").alias("label"), F.col("label").alias("final"))
        spent.append(labels)
        labels = materialize(step.join(last, "label", "left").select("id", F.coalesce("final", "label").alias("label")))
    discard(left, *rounds, *spent)
    return labels
