"""Substring deduplication by prefix-partitioned suffix trees over words.

A suffix is a position with at least `window` words behind it. Its path is the sequence of hashes of its prefixes of 8, 16, 32 and
`window` words, so the order of paths is a suffix order in which common prefixes lie side by side. Four steps:

1. Every window has an anchor, the smallest hash of its 8-word runs; equal windows have equal anchors. Anchors that occur
   in one document only rule out their windows at once. The same pass counts suffixes by the slots of their prefixes of
   each length.
2. The other suffixes are split into groups by a prefix of variable length: of 8 words, or, where the counts say that the
   slot is too full for a group, of the next longer length. Each block of documents sends one leaf per distinct suffix
   (smallest and largest document). Where even the longest prefix's slot is too full, a passage is in very many documents; there
   the leaves of up to FAN blocks are merged first, so that it puts one leaf per FAN blocks into its group.
3. In each group the leaves are sorted into suffix order, and the lengths of the common prefixes of neighbours give the inner
   nodes of the group's suffix tree, which is cut at depth `window`. A node of that depth is a repeat; its smallest document
   keeps the words.
4. The leaves below such nodes that have later documents go back to their blocks, which mark the covered words; runs of
   marked suffixes are the maximal repeats.

Only documents with marked words are shuffled with their texts. Prefixes are compared by hashes: 64 bits for whole windows, 32
bits (beside those of the group) for the shorter ones, which only order the leaves.

Defined results: null text has no words; rows that share an identifier are not smaller than each other, so neither loses
words to the other; a null identifier counts as larger than all others; repetition inside one document removes nothing;
texts of fewer than `window` words stay whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, materialize
from .textkernel import mix, sequences, texts, trim, word_hashes, words

WINDOW, ANCHOR, SLOTS = 50, 8, 1024
#: Suffixes that a group should hold at most, suffixes in a block, and blocks whose leaves are merged before the tree.
GROUP, BLOCK, FAN = 200_000, 50_000, 256
NO_ID = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def windows(b: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words before each document, the anchor of each window, windows before each document."""
    starts, ends, first = words(b, off)
    h = word_hashes(b, starts, ends)
    runs, before_runs = sequences(h, first, ANCHOR)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    if not before[-1]:
        return h, first, np.zeros(0, np.uint64), before
    lows = sliding_min(runs, width - ANCHOR + 1)
    return h, first, lows[np.repeat(before_runs[:-1] - before[:-1], counts) + np.arange(before[-1])], before


def lengths(width: int) -> list[int]:
    return [x for x in (8, 16, 32) if x < width] + [width]


def prefix_hashes(h: np.ndarray, first: np.ndarray, before: np.ndarray, width: int) -> list[np.ndarray]:
    """For each prefix length, the hash of each window's prefix."""
    out, counts = [], np.diff(before)
    for length in lengths(width):
        s, b = sequences(h, first, length)
        out.append(s[np.repeat(b[:-1] - before[:-1], counts) + np.arange(before[-1])] if before[-1] else s[:0])
    return out


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(54)).astype(np.int64)


def short_hash(h: np.ndarray) -> np.ndarray:
    """What a path keeps of a shorter prefix: bits that its slot does not have."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def ids_of(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def row_key(doc_id: int, text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=int(doc_id).to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Anchors that two documents share (kind 0: key, lo, hi) and counts of prefix slots (kind 1: key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = len(lengths(width))
        counts = np.zeros(levels * SLOTS, np.int64)
        for batch in batches:
            doc_ids = ids_of(batch.column(0))
            for i, j, b, off in texts(batch.column(1)):
                h, first, low, before = windows(b, off, width)
                if not len(low):
                    continue
                for level, p in enumerate(prefix_hashes(h, first, before, width)):
                    counts[level * SLOTS : (level + 1) * SLOTS] += np.bincount(slot(p), minlength=SLOTS)
                doc = np.repeat(doc_ids[i:j], np.diff(before))
                fresh = np.ones(len(low), dtype=bool)
                fresh[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                low, doc = low[fresh], doc[fresh]
                order = np.argsort(low, kind="stable")
                low, doc = low[order], doc[order]
                at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                yield _batch(kind=np.zeros(len(at), np.int32), key=low[at].view(np.int64), lo=np.minimum.reduceat(doc, at), hi=np.maximum.reduceat(doc, at), n=np.zeros(len(at), np.int64))
        used = np.flatnonzero(counts)
        yield _batch(kind=np.ones(len(used), np.int32), key=used, lo=np.zeros(len(used), np.int64), hi=np.zeros(len(used), np.int64), n=counts[used])

    found = docs.mapInArrow(run, "kind int, key long, lo long, hi long, n long")
    found = found.groupBy("kind", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return materialize(found.where("kind = 1 or lo < hi"))


def _batch(**columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _blocks(docs: DataFrame, width: int, anchors, heavy, sub_bits: int) -> DataFrame:
    """One row per block of documents: its suffixes with a shared anchor, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n, doc_ids, keys = TaskContext.get().partitionId() << 32, [], 0, [], []

        def flush() -> pa.RecordBatch:
            parts = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
            return _batch(block=[block], docs=[np.array(doc_ids, np.int64).tobytes()], keys=[np.array(keys, np.int64).tobytes()], **{k: [v] for k, v in zip(("idx", "pos", "path", "suffix", "grp"), parts, strict=True)})

        for batch in batches:
            own = ids_of(batch.column(0))
            for i, _, b, off in texts(batch.column(1)):
                h, first, low, before = windows(b, off, width)
                if not len(low):
                    continue
                keep = bloom.contains(anchors.value, low)
                if not keep.any():
                    continue
                prefixes = prefix_hashes(h, first, before, width)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(before))
                pos = np.arange(before[-1]) - before[:-1][doc]
                doc, pos, prefixes = doc[keep], pos[keep], [p[keep] for p in prefixes]
                group = np.full(len(doc), -1, np.int64)
                for level, p in enumerate(prefixes):
                    s = slot(p)
                    fits = (group < 0) & ((level == len(prefixes) - 1) | ~heavy.value[level][s])
                    fine = (p << np.uint64(10) >> np.uint64(64 - sub_bits)).astype(np.int64) if sub_bits else 0
                    group = np.where(fits, ((level * SLOTS + s) << sub_bits) + fine, group)
                docs_here, idx = np.unique(doc, return_inverse=True)
                path = np.stack([short_hash(p) for p in prefixes[:-1]] or [np.zeros(len(doc), np.uint32)], axis=1)
                held.append((idx.astype(np.int32) + np.int32(len(doc_ids)), pos.astype(np.int32), path, prefixes[-1], group))
                for k in docs_here.tolist():
                    doc_ids.append(int(own[i + k]))
                    keys.append(row_key(own[i + k], b[off[k] : off[k + 1]].tobytes()))
                n += len(doc)
                if n >= BLOCK:
                    yield flush()
                    block, held, n, doc_ids, keys = block + 1, [], 0, [], []
        if held:
            yield flush()

    return materialize(docs.mapInArrow(run, "block long, docs binary, keys binary, idx binary, pos binary, path binary, suffix binary, grp binary"))


class SuffixTree:
    """Leaves in suffix order and the common prefixes of neighbours, cut at the longest of the lengths.

    path: for each leaf the hashes of its shorter prefixes; suffix: of its longest.
    """

    def __init__(self, path: np.ndarray, suffix: np.ndarray, lengths: list[int]):
        self.order = np.lexsort((suffix, *path.T[::-1]))
        self.path, self.suffix, self.depth = path[self.order], suffix[self.order], lengths[-1]
        #: Common prefix, in words, of each leaf with the one before it.
        self.common = np.zeros(len(suffix), np.int64)
        alike = np.ones(max(0, len(suffix) - 1), dtype=bool)
        for length, column in zip(lengths, [*self.path.T, self.suffix] if len(lengths) > 1 else [self.suffix], strict=True):
            alike &= column[1:] == column[:-1]
            self.common[1:][alike] = length

    def nodes(self, depth: int | None = None) -> np.ndarray:
        """First leaves of the nodes of at least this depth: runs of neighbours that share as long a prefix."""
        return np.flatnonzero(self.common < (depth or self.depth))


def _merged(path: np.ndarray, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """One leaf for each suffix, in suffix order."""
    tree = SuffixTree(path, suffix, sizes)
    at = tree.nodes()
    return tree.path[at], tree.suffix[at], np.minimum.reduceat(lo[tree.order], at), np.maximum.reduceat(hi[tree.order], at)


LEAF = (("path", np.uint32), ("suffix", np.uint64), ("lo", np.int64), ("hi", np.int64))


def _packed(table: pa.Table, sizes: list[int]) -> list[np.ndarray]:
    path, *rest = (np.frombuffer(b"".join(table[k].to_pylist()), t) for k, t in LEAF)
    return [path.reshape(-1, max(1, len(sizes) - 1)), *rest]


def _leaves(sizes: list[int], full, salts: int, crowded: bool, with_path: bool = True):
    """From each block, one leaf per distinct suffix, packed by group; of crowded groups or of the others.

    full: slots of the longest prefix that are too full for a group. Other groups' salt is the block itself.
    """
    last = len(sizes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd, sub_bits = full.value
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                suffix, group = np.frombuffer(row["suffix"], np.uint64), np.frombuffer(row["grp"], np.int64)
                wanted = (((group >> sub_bits) // SLOTS == last) & crowd[(group >> sub_bits) % SLOTS]) == crowded
                if not wanted.any():
                    continue
                path = np.frombuffer(row["path"], np.uint32).reshape(len(suffix), -1)[wanted]
                doc = np.frombuffer(row["docs"], np.int64)[np.frombuffer(row["idx"], np.int32)[wanted]]
                suffix, group = suffix[wanted], group[wanted]
                order = np.lexsort((suffix, group))
                suffix, group, doc = suffix[order], group[order], doc[order]
                at = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (group[1:] != group[:-1])]))
                path, suffix, group, lo, hi = path[order[at]], suffix[at], group[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
                cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(group)]])
                pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
                block = np.full(len(pieces), row["block"])
                salt = (mix(block.astype(np.uint64)) % np.uint64(salts)).astype(np.int64) if crowded else block
                columns = {"path": path, "suffix": suffix, "lo": lo, "hi": hi} if with_path else {"suffix": suffix, "hi": hi}
                yield _batch(grp=group[cuts[:-1]], salt=salt, **({} if with_path else {"block": block}), **{k: pa.array([v[a:z].tobytes() for a, z in pieces], pa.binary()) for k, v in columns.items()})
        trim()

    return run


def _first(sizes: list[int]):
    def run(table: pa.Table) -> pa.Table:
        """The merged leaves of some blocks of one group."""
        parts = _merged(*_packed(table, sizes), sizes)
        return pa.table({"grp": table["grp"][:1], "salt": table["salt"][:1], **{k: pa.array([v.tobytes()], pa.binary()) for (k, _), v in zip(LEAF, parts, strict=True)}})

    return run


def _tree(sizes: list[int]):
    def run(table: pa.Table) -> pa.Table:
        """The leaves below deep nodes of one group's suffix tree, with the node's smallest document, if later ones are there."""
        path, suffix, lo, hi = _packed(table, sizes)
        salt = np.repeat(table["salt"].to_numpy(), [len(x) // 8 for x in table["suffix"].to_pylist()])
        tree = SuffixTree(path, suffix, sizes)
        at = tree.nodes()
        least = np.repeat(np.minimum.reduceat(lo[tree.order], at), np.diff(np.concatenate([at, [len(suffix)]])))
        late = hi[tree.order] > least
        suffix, least, salt = tree.suffix[late], least[late], salt[tree.order][late]
        order = np.argsort(salt, kind="stable")  # keeps the suffixes of a salt in their order
        suffix, least, salt = suffix[order], least[order], salt[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], salt[1:] != salt[:-1]])) if len(salt) else [], [len(salt)]]).astype(int)
        pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
        trim()
        return pa.table({"grp": pa.array([table["grp"][0].as_py()] * len(pieces), pa.int64()), "salt": pa.array(salt[cuts[:-1]], pa.int64()), **{k: pa.array([v[a:z].tobytes() for a, z in pieces], pa.binary()) for k, v in (("suffix", suffix), ("least", least))}})

    return run


def _answer(own: pa.Table, found: pa.Table) -> pa.Table:
    """For each block of one group and salt, its suffixes below deep nodes that have documents later than the node's first."""
    out = []
    if found.num_rows:
        suffix, least = (np.frombuffer(b"".join(found[k].to_pylist()), t) for k, t in (("suffix", np.uint64), ("least", np.int64)))
        order = np.argsort(suffix)
        suffix, least = suffix[order], least[order]
        for block, mine, hi in zip(own["block"].to_pylist(), own["suffix"].to_pylist(), own["hi"].to_pylist(), strict=True):
            mine, hi = np.frombuffer(mine, np.uint64), np.frombuffer(hi, np.int64)
            at = np.minimum(np.searchsorted(suffix, mine), len(suffix) - 1)
            late = (suffix[at] == mine) & (hi > least[at])
            if late.any():
                out.append((block, mine[late].tobytes(), least[at[late]].tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "suffix", "least"])


def repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """key, spans: for each row of docs with words to remove, its key and the packed starts and ends of its maximal repeats."""
    spark = docs.sparkSession
    survey = _survey(docs, width)
    counted = survey.where("kind = 1").select("key", "n").toArrow()  # at most a few thousand slots
    counts = np.zeros(len(lengths(width)) * SLOTS, np.int64)
    counts[counted["key"].to_numpy()] = counted["n"].to_numpy()
    counts = counts.reshape(-1, SLOTS)
    sub_bits = max(0, int(counts[0].sum() // (GROUP * SLOTS)).bit_length())
    heavy = counts > max(4 * counts[0].sum() // SLOTS, GROUP << sub_bits)
    anchors = spark.sparkContext.broadcast(bloom.build(survey.where("kind = 0").select("key")))
    blocks = _blocks(docs, width, anchors, spark.sparkContext.broadcast(heavy), sub_bits)
    sizes = lengths(width)
    salts = max(1, -(-blocks.count() // FAN))
    full = spark.sparkContext.broadcast((heavy[-1], sub_bits))
    packed = "grp long, salt long, path binary, suffix binary, lo binary, hi binary"
    found = "grp long, salt long, suffix binary, least binary"
    most = blocks.mapInArrow(_leaves(sizes, full, salts, crowded=False), packed)
    nodes = [materialize(most.groupBy("grp").applyInArrow(_tree(sizes), found))]
    answers = nodes[0].select(F.col("salt").alias("block"), "suffix", "least")
    if heavy[-1].any():
        rest = blocks.mapInArrow(_leaves(sizes, full, salts, crowded=True), packed)
        merged = rest.groupBy("grp", "salt").applyInArrow(_first(sizes), packed)
        nodes.append(materialize(merged.groupBy("grp").applyInArrow(_tree(sizes), found)))
        short = blocks.mapInArrow(_leaves(sizes, full, salts, crowded=True, with_path=False), "grp long, salt long, block long, suffix binary, hi binary")
        answers = answers.union(short.groupBy("grp", "salt").cogroup(nodes[1].groupBy("grp", "salt")).applyInArrow(_answer, "block long, suffix binary, least binary"))

    def mark(own: pa.Table, found: pa.Table) -> pa.Table:
        keys, spans = [], []
        for row in own.to_pylist() if found.num_rows else []:
            suffix = np.frombuffer(b"".join(found["suffix"].to_pylist()), np.uint64)
            least = np.frombuffer(b"".join(found["least"].to_pylist()), np.int64)
            order = np.argsort(suffix)
            suffix, least = suffix[order], least[order]
            mine, idx, pos = np.frombuffer(row["suffix"], np.uint64), np.frombuffer(row["idx"], np.int32), np.frombuffer(row["pos"], np.int32)
            at = np.minimum(np.searchsorted(suffix, mine), len(suffix) - 1)
            late = (suffix[at] == mine) & (np.frombuffer(row["docs"], np.int64)[idx] > least[at])
            idx, pos = idx[late].astype(np.int64), pos[late].astype(np.int64)
            order = np.lexsort((pos, idx))
            idx, pos = idx[order], pos[order]
            fresh = np.ones(len(idx), dtype=bool)  # a window that does not touch the one before begins a repeat
            fresh[1:] = (idx[1:] != idx[:-1]) | (pos[1:] > pos[:-1] + width)
            begins = np.flatnonzero(fresh)
            ends = np.concatenate([begins[1:], [len(idx)]]) - 1
            both = np.stack([pos[begins], pos[ends] + width], axis=1) if len(begins) else np.zeros((0, 2), np.int64)
            row_keys = np.frombuffer(row["keys"], np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(idx[begins]) != 0])) if len(begins) else np.zeros(0, np.int64)
            for a, z in zip(cuts, [*cuts[1:], len(begins)], strict=True):
                keys.append(int(row_keys[idx[begins[a]]]))
                spans.append(both[a:z].tobytes())
        trim()
        return pa.table({"key": pa.array(keys, pa.int64()), "spans": pa.array(spans, pa.binary())})

    own = blocks.select("block", "docs", "keys", "idx", "pos", "suffix")
    marked = materialize(own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "key long, spans binary"))
    discard(survey, blocks, *nodes)
    return marked


def _kept(text: bytes, spans: bytes | None) -> tuple[int, int, list[bytes]]:
    own = text.split()
    keep, last, removed = [], 0, 0
    for a, z in np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist():
        keep += own[last:a]
        removed += z - max(a, last)
        last = max(last, z)
    return len(own), removed, keep + own[last:]


def remove_repeats(docs: DataFrame, width: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept (the words that stay)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeats(docs, width)
    flagged = docs.sparkSession.sparkContext.broadcast(bloom.build(spans.select("key")))
    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept string, rest binary"

    def finish(row_id: int | None, key: int, text: bytes, own: bytes | None) -> tuple:
        n, removed, keep = _kept(text, own)
        kept = b" ".join(keep)
        return row_id, key, n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, None

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, raw_ids = ids_of(batch.column(0)), batch.column(0).to_pylist()
            for i, j, b, off in texts(batch.column(1)):
                raw = [b[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                keys = np.array([row_key(d, t) for d, t in zip(own[i:j], raw, strict=True)], np.int64)
                hit = bloom.contains(flagged.value, keys.view(np.uint64))
                yield table([(raw_ids[i + k], key, 0, 0, None, None, t) if hit[k] else finish(raw_ids[i + k], key, t, None) for k, (key, t) in enumerate(zip(keys.tolist(), raw, strict=True))])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            done = [finish(r[0], r[1], r[6], r[7]) if r[6] is not None else r[:7] for r in rows]
            if done:
                yield table(done)

    met = docs.mapInArrow(first, schema).join(spans.dropDuplicates(["key"]), "key", "left").select(*names, "spans")
    return met.mapInArrow(second, schema).select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
