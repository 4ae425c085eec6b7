"""A Bloom filter sized by its keys, filled on the executors; only its bits, at most 2 ** MOST_BITS, reach the driver.

It only spares work: whatever passes by mistake is settled by the exact step behind it, at any fill. With more keys than a
filter of the largest size can tell apart it would pass nearly everything; then there is none, and everything does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix

U = np.uint64
#: Bits for each key, smallest and largest filter as powers of two; a filter is of no use below USELESS bits a key.
PER_KEY, LEAST_BITS, MOST_BITS, USELESS = 12, 16, 28, 2


@dataclass
class Filter:
    size: int  # log2 of the bits
    bits: np.ndarray | None  # None: passes everything


def positions(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys ^ U(0xA0761D6478BD642F))
    return h >> U(64 - size), (h << U(size)) >> U(64 - size)


def contains(own: Filter, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    if own.bits is not None:
        for p in positions(keys, own.size):
            out &= (own.bits[(p >> U(6)).astype(np.int64)] >> (p & U(63)) & U(1)).astype(bool)
    return out


def build(keys: DataFrame) -> Filter:
    """A filter that holds the one column (a long) of keys, a written table."""
    n = keys.count()
    if n * USELESS > 1 << MOST_BITS:
        return Filter(0, None)
    size = min(MOST_BITS, max(LEAST_BITS, (n * PER_KEY - 1).bit_length()))

    def run(batches):
        for batch in batches:
            p = np.concatenate(positions(batch.column(0).to_numpy(zero_copy_only=False).view(U), size))
            words, which = np.unique(p >> U(6), return_inverse=True)
            bits = np.zeros(len(words), U)
            np.bitwise_or.at(bits, which, U(1) << (p & U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), U)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return Filter(size, out)
