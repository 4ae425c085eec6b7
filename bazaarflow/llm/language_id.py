"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the byte n-grams that are usual in it; the filters are sliced, so one look at a slot
returns a bit for each language, and the AND over the hash functions is the set of languages that contain the n-gram.
A document's counts per language are corrected for each filter's false positives; the largest decides.

The filters are learned from a bounded number of texts for each language. Language, source and identifier
are never inputs of a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; texts whose n-grams no filter knows get the
most frequent learned language with score 0; without any learned language all are `und`; repeated rows are judged alike; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialize
from .textkernel import mix, texts
from .toxicity import fold_case

#: Bytes of an n-gram, texts learned from for each language, n-grams kept for each language, slots as a power of two.
SIZE, MAX_FIT, MAX_GRAMS, SLOT_BITS, HASHES = 5, 2000, 60_000, 20, 2
#: A language keeps an n-gram if its rate there is at least this share of the highest rate in any language.
USUAL = 0.25
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def grams(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that have three letters or more, of words of one or two bytes, and their documents.

    Other bytes than letters count as spaces, and every text has one before and one behind it.
    """
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(off) - 1
    place = np.arange(len(b)) + 2 * np.repeat(np.arange(size), np.diff(off)) + 1
    off = off + 2 * np.arange(size + 1)
    known = _LETTER[b]
    letter, clean = np.zeros(off[-1], dtype=bool), np.full(off[-1], 32, np.uint8)
    letter[place], clean[place] = known, np.where(known, fold_case(b), 32)
    padded = np.concatenate([clean, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(clean),), "<u8", padded.data, strides=(1,))
    sums = np.concatenate([[0], np.cumsum(letter)])
    good = sums[SIZE:] - sums[:-SIZE] >= 3
    for k in off[1:-1]:  # none across documents
        good[max(0, k - SIZE + 1) : k] = False
    found, at = [np.flatnonzero(good)], np.flatnonzero(~letter[:-1] & letter[1:])  # the space before each word
    keys = [eight[found[0]] & np.uint64((1 << 8 * SIZE) - 1)]
    for k in (1, 2):
        whole = at[~letter[at + k + 1]]
        found.append(whole)
        keys.append(eight[whole] & np.uint64((1 << 8 * (k + 2)) - 1))
        at = at[letter[at + k + 1]]
    return mix(np.concatenate(keys)), np.searchsorted(off, np.concatenate(found), side="right") - 1


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # one row of bytes per eight languages
    false_rate: np.ndarray

    def counts(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected counts, documents by languages."""
        h, doc = grams(b, off)
        n, size = np.bincount(doc, minlength=len(off) - 1).astype(float), len(off) - 1
        out = []
        for row in self.slots:
            mask = np.full(len(h), 255, np.uint8)
            for k in range(HASHES):
                mask &= row[(h << np.uint64(k * SLOT_BITS) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            by_mask = np.bincount(doc * 256 + mask, minlength=size * 256).reshape(size, 256)
            out.append(by_mask @ (np.arange(256)[:, None] >> np.arange(8) & 1))
        found = np.concatenate(out, axis=1)[:, : len(self.languages)]
        return np.maximum(found - n[:, None] * self.false_rate, 0) / (1 - self.false_rate)


def fit(docs: DataFrame, held_out: Column, max_fit: int = MAX_FIT, max_grams: int = MAX_GRAMS) -> Filters:
    """Filters of at most max_grams n-grams for each language, from about max_fit texts of each."""
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    totals = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not totals:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    share = F.create_map(*[y for x in languages for y in (F.lit(x), F.lit(min(1.0, max_fit / totals[x])))])
    picked = own.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    index = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j, b, off in texts(batch.column(0)):
                h, doc = grams(b, off)
                for k in np.unique(lang[i:j]):
                    keys, n = np.unique(h[lang[i + doc] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    # counted once for all languages; the sample bounds this table
    counted = materialize(picked.select("text", "lang").mapInArrow(count, "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).where("n > 1"))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("n") / F.col("total"))  # one size per language
    highest = rated.groupBy("key").agg(F.max("rate").alias("highest"))
    usual = rated.join(highest, "key").where(F.col("rate") >= USUAL * F.col("highest"))
    best = Window.partitionBy("lang").orderBy(F.desc("rate"), "key")
    kept = usual.withColumn("place", F.row_number().over(best)).where(F.col("place") <= max_grams).select("lang", "key").toArrow()
    slots = np.zeros((-(-len(languages) // 8), 1 << SLOT_BITS), np.uint8)
    every, keys = kept["lang"].to_numpy(), kept["key"].to_numpy().view(np.uint64)
    for k in range(len(languages)):
        for q in range(HASHES):
            slots[k // 8, (keys[every == k] << np.uint64(q * SLOT_BITS) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] |= np.uint8(1 << k % 8)
    fill = np.array([(slots[k // 8] >> (k % 8) & 1).mean() for k in range(len(languages))])
    return Filters(languages, slots, fill**HASHES)


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the winner's share of all counts)."""
    held_out = fold(F.col("doc_id"), modulus) == held
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs, held_out, max_grams=max_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters.value
        for batch in batches:
            names, scores = [], []
            for i, j, b, off in texts(batch.column(1)):
                found = own.counts(b, off) if own.languages else np.zeros((j - i, 1))
                best, total = found.argmax(axis=1), found.sum(axis=1)
                sums = np.concatenate([[0], np.cumsum(_LETTER[b] & (b < 128))])
                plain = sums[off[1:]] > sums[off[:-1]]
                for k in range(j - i):
                    if not own.languages or not (plain[k] or any(c.isalpha() for c in b[off[k] : off[k + 1]].tobytes().decode())):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        names.append(own.languages[best[k]])
                        scores.append(float(found[k, best[k]] / total[k]) if total[k] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
