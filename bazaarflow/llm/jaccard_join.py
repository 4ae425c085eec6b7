"""Exact n-gram Jaccard join by parity sketches.

Two sets of sizes a <= b with similarity 0.75 or more differ in at most (a + b) / 7 elements. Sets are banded by size, a
set takes part in the band of its own size and, as the smaller one, in the next. In a band with at most d differences the
hash range is cut into m > d segments and the 64-bit hashes of a set's elements are XORed by segment: each element that
only one of two sets has changes one segment of the sketch, so a set of n elements, which differs from a partner in the
band in no more than (n + the largest partner's size) / 7, finds at least r = (non-empty segments) - (those differences) of
its segments in that partner. Sets with r < 1 also send which segments are empty. Sets of up to SMALL elements use a segment
of its own for each element: r is then 75 % of the size.

1. Segments are matched over the corpus as packed keys, each once per block of documents: a key that a third of all sets
   have comes once from each block, and the block itself knows its other holders. A set with fewer than r keys that another
   set has too can have no partner; nearly every document without near copies leaves here.
2. The others' keys are matched again among themselves. A set drops its r - 1 most frequent keys: of r shared ones the
   rarest stays in both sets, whatever passages many documents share. One edge per remaining key and set, to the key's
   smallest set in the block, and from there to the smallest of all blocks, gives candidate families; no pairs are listed.
3. Families are verified with their full sets: a pivot is compared to all sets of its family, linked sets are united, and
   the next pivot comes from outside the largest united group until every set outside it has been a pivot. Links are
   thereby neither lost nor repeated. Families beyond PART elements or PART_SETS sets are cut into parts and get their
   pivots, in growing numbers of bounded bytes, by a join; parts stay bounded.

Sets are known by a 64-bit hash of their elements; equal sets are one node, and are counted once per block before any
shuffle.

Defined results: null and empty texts have no shingles and link with nothing; rows of one identifier and different
texts are separate nodes; a null identifier never becomes a component's name unless all are null; repeated rows are linked;
an empty table gives an empty table; other columns are ignored by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import discard, free_names, materialize, shuffle_width
from .components import components
from .textkernel import mix, shingle_sets, texts, trim

U = np.uint64
SMALL, SLACK, SALTS = 64, 1.2, 64
#: Keys in a packed flush and in a bucket, sets in a flush (a reference of 16 bits names 16,384 at most).
FLUSH, BUCKET, FLUSH_DOCS = 500_000, 1_000_000, 16_000
#: Stands for all sets of a block that share a key.
SEVERAL = 0xFFFF
#: Elements and sets in a part of a family.
PART, PART_SETS = 1_000_000, 20_000
#: Pivots of a family in each round; the last number holds for all further rounds. Elements of a round's pivots, about.
PIVOTS, PIVOT_ELEMENTS = (32, 1024, 4096), 2_000_000
#: Bits of a set's sketch in verification.
SKETCH = 4096

_edges = [SMALL + 1]
while _edges[-1] < 1 << 40:
    _edges.append(_edges[-1] * 4 // 3 + 1)
#: First size of each band.
BANDS = np.array(_edges)


def set_ids(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per set; 0 for an empty one."""
    out, full = np.zeros(len(first) - 1, U), np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(s ^ U(0x1F83D9ABFB41BD6B)), first[:-1][full]) ^ mix(np.diff(first)[full].astype(U))) | U(1)
    return out


def keys(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, 4 * set's number + role) of all sketches, and the least number of shared keys that each role asks for."""
    n, docs = np.diff(first), len(first) - 1
    doc = np.repeat(np.arange(docs), n)
    band = np.searchsorted(BANDS, n, side="right") - 1
    need = np.full(docs * 4, np.iinfo(np.int32).max, np.int32)
    out, refs = [], []
    for role in (0, 1):
        used = np.flatnonzero(n > SMALL)
        if role:  # the next band, for sets that are large enough for a partner there
            used = used[n[used] * 4 // 3 >= BANDS[band[used] + 1]]
        if not len(used):
            continue
        g = band[used] + role
        # all sets of a band use the same segments; how many may differ is a matter of the set's own size
        m = np.ceil(SLACK * (2 * (BANDS[g + 1] - 1) // 7 + 1)).astype(np.int64) + 2
        most = (n[used] + np.minimum(BANDS[g + 1] - 1, n[used] * 4 // 3)) // 7
        width, base = np.zeros(docs, U), np.zeros(docs, np.int64)
        width[used], base[used] = m.astype(U), np.concatenate([[0], np.cumsum(m)[:-1]])
        mine = width[doc] > 0
        x, own = s[mine], doc[mine]
        cell = base[own] + ((x >> U(32)) * width[own] >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        owner = own[at]
        place = (cell[at] - base[owner]).astype(U) + ((band[owner] + role).astype(U) << U(40))
        out.append(mix(np.bitwise_xor.reduceat(mix(x), at) ^ mix(place)))
        refs.append(owner * 4 + role)
        filled = np.bincount(owner, minlength=docs)[used]
        r = filled - most
        need[used * 4 + role] = np.maximum(r, 1)
        for k in np.flatnonzero(r < 1):  # rare: empty segments are keys too
            own_cells = cell[at][owner == used[k]] - base[used[k]]
            gaps = np.setdiff1d(np.arange(m[k]), own_cells).astype(U)
            out.append(mix(mix(gaps + (U(g[k]) << U(40))) ^ U(0x3C6EF372FE94F82B)))
            refs.append(np.full(len(gaps), used[k] * 4 + role))
    small = (n > 0) & (n <= SMALL * 4 // 3 + 1)
    mine = small[doc]
    out.append(mix(s[mine] ^ U(0x510E527FADE682D1)))
    refs.append(doc[mine] * 4 + 2)
    need[np.flatnonzero(small) * 4 + 2] = -(-3 * n[small] // 4)
    return np.concatenate(out), np.concatenate(refs), need


KEYED = "bucket int, dictionary boolean, block long, a binary, b binary, c binary, d binary"


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _whole(key: np.ndarray, buckets: int) -> np.ndarray:
    """A key as its bucket and its last five bytes."""
    return key & U((1 << 40) - 1) | _bucket(key, buckets).astype(U) << U(40)


def _keyed(docs: DataFrame, buckets: int, only=None) -> DataFrame:
    """Packed keys by bucket, and for each block its dictionary: sets, least numbers of shared keys, and holders of shared keys.

    `only`: a filter of the sets to send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sids, needs, seen, n = TaskContext.get().partitionId() << 24, [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            key, ref = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(seen) > 1 << 14:
                raise ValueError("more sets in a flush than a reference can name")
            order = np.argsort(key, kind="stable")
            key, ref = key[order], ref[order].astype(np.uint16)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.concatenate([at, [len(key)]]))
            shared = np.repeat(times > 1, times)
            holders, theirs = key[shared], ref[shared]
            key, ref = key[at], np.where(times > 1, np.uint16(SEVERAL), ref[at])
            bucket = _bucket(key, buckets)
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(key)]])
            five = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            own = [(int(bucket[i]), False, block, five[i:j].tobytes(), ref[i:j].tobytes(), None, None) for i, j in spans]
            known = _whole(holders, buckets).tobytes() if only is not None else None  # the first pass has no use for them
            own.append((int(block * 7919 % buckets), True, block, np.concatenate(sids).tobytes(), np.concatenate(needs).tobytes(), theirs.tobytes(), known))
            kinds = [pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], ["bucket", "dictionary", "block", "a", "b", "c", "d"])

        for batch in batches:
            for _, _, b, off in texts(batch.column(0)):
                s, first = shingle_sets(b, off)
                sid = set_ids(s, first)
                fresh = np.zeros(len(sid), dtype=bool)
                _, at = np.unique(sid, return_index=True)
                fresh[at] = True
                fresh &= sid != 0
                if only is not None:
                    fresh &= bloom.contains(only.value, sid)
                fresh[[k for k in np.flatnonzero(fresh) if int(sid[k]) in seen]] = False
                if not fresh.any():
                    continue
                keep = np.repeat(fresh, np.diff(first))
                s, first = s[keep], np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
                sid = sid[fresh]
                for i in range(0, len(sid), FLUSH_DOCS):  # a step of short texts may hold more sets than a flush
                    own = sid[i : i + FLUSH_DOCS]
                    if held and (n >= FLUSH or len(seen) + len(own) > FLUSH_DOCS):
                        yield flush()
                        block, held, sids, needs, seen, n = block + 1, [], [], [], {}, 0
                    cuts = first[i : i + len(own) + 1]
                    key, ref, need = keys(s[cuts[0] : cuts[-1]], cuts - cuts[0])
                    held.append((key, ref + 4 * len(seen)))
                    sids.append(own)
                    needs.append(need)
                    seen.update(dict.fromkeys(own.tolist()))
                    n += len(key)
                if n >= FLUSH:
                    yield flush()
                    block, held, sids, needs, seen, n = block + 1, [], [], [], {}, 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, KEYED)


def _unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, blocks (as their place in rows) and references of packed rows, sorted by key."""
    five = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    key = wide.view("<u8").ravel()
    ref = np.frombuffer(b"".join(r["b"] for r in rows), np.uint16)
    block = np.repeat(np.arange(len(rows)), [len(r["b"]) // 2 for r in rows])
    order = np.argsort(key)
    return key[order], block[order], ref[order]


def _frequency(key: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.repeat(np.diff(np.concatenate([at, [len(key)]])), np.diff(np.concatenate([at, [len(key)]])))


def _match(table: pa.Table, with_keys: bool) -> pa.Table:
    """For each block: how many keys of each reference occur elsewhere too; or those keys, and in how many blocks they do."""
    rows = table.to_pylist()
    out = [(True, r["block"], r["a"], r["b"], r["c"], r["d"]) for r in rows if r["dictionary"]]
    rows = [r for r in rows if not r["dictionary"]]
    if rows:
        key, block, ref = _unpack(rows)
        frequency = _frequency(key)
        common = (frequency > 1) | (ref == SEVERAL) if with_keys else (frequency > 1) & (ref != SEVERAL)
        key, block, ref, frequency = key[common], block[common], ref[common], frequency[common]
        order = np.argsort(block, kind="stable")
        key, block, ref, frequency = key[order], block[order], ref[order], frequency[order]
        cuts = np.searchsorted(block, np.arange(len(rows) + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[k], cuts[k + 1]
            if with_keys:
                whole = key[i:j] | U(rows[k]["bucket"]) << U(40)
                out.append((False, rows[k]["block"], ref[i:j].tobytes(), whole.tobytes(), frequency[i:j].astype(np.int32).tobytes(), None))
            else:
                which, count = np.unique(ref[i:j], return_counts=True)
                out.append((False, rows[k]["block"], which.tobytes(), count.astype(np.int32).tobytes(), None, None))
    trim()
    kinds = [pa.bool_(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dictionary", "block", "a", "b", "c", "d"])


MATCHED = "dictionary boolean, block long, a binary, b binary, c binary, d binary"


def _survivors(table: pa.Table) -> pa.Table:
    """The sets of one block that share enough keys."""
    rows = table.to_pylist()
    book = next(r for r in rows if r["dictionary"])
    sids, need = np.frombuffer(book["a"], np.int64), np.frombuffer(book["b"], np.int32)
    counts = np.bincount(np.frombuffer(book["c"], np.uint16), minlength=len(need))
    for r in rows:
        if not r["dictionary"]:
            counts[np.frombuffer(r["a"], np.uint16)] += np.frombuffer(r["b"], np.int32)
    return pa.table({"sid": sids[np.unique(np.flatnonzero(counts >= need) // 4)]})


def _rarest(table: pa.Table) -> pa.Table:
    """Without each set's r - 1 most frequent keys: (key, smallest set) of one block, and edges (null, smallest, other set)."""
    rows = table.to_pylist()
    book = next(r for r in rows if r["dictionary"])
    sids, need = np.frombuffer(book["a"], np.int64), np.frombuffer(book["b"], np.int32)
    rows = [r for r in rows if not r["dictionary"]]
    ref, key, frequency = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("a", np.uint16), ("b", np.int64), ("c", np.int32)))
    # keys of several sets: put the holders in the place of the one entry
    known, theirs = np.frombuffer(book["d"], np.int64), np.frombuffer(book["c"], np.uint16)
    order = np.argsort(known, kind="stable")
    known, theirs = known[order], theirs[order]
    many = ref == SEVERAL
    i, j = np.searchsorted(known, key[many]), np.searchsorted(known, key[many], side="right")
    n = j - i
    spots = np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ref = np.concatenate([ref[~many], theirs[spots]]).astype(np.int64)
    key = np.concatenate([key[~many], np.repeat(key[many], n)])
    frequency = np.concatenate([frequency[~many], np.repeat(frequency[many], n)])
    order = np.lexsort((key, -frequency, ref))  # the same order in every set
    ref, key = ref[order], key[order]
    counts = np.bincount(ref, minlength=len(need))
    rank = np.arange(len(ref)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = (counts[ref] >= need[ref]) & (rank >= need[ref] - 1)
    key, own = key[keep], sids[ref[keep] // 4]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    hub = np.repeat(own[at], np.diff(np.concatenate([at, [len(key)]])))
    edges = np.unique(np.stack([hub, own], axis=1)[hub != own], axis=0)
    return pa.table({"key": pa.concat_arrays([pa.array(key[at]), pa.nulls(len(edges), pa.int64())]), "a": np.concatenate([own[at], edges[:, 0]]), "b": np.concatenate([own[at], edges[:, 1]])})


def _parity(elements: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """A sketch of SKETCH bits for each of n sets: every element turns one bit over."""
    out = np.zeros(n * SKETCH // 64, U)
    bit = elements >> U(64 - SKETCH.bit_length() + 1)
    np.bitwise_xor.at(out, owners * (SKETCH // 64) + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(n, -1)


class _Family:
    """The sets of a family, or of a part of it, with their sketches and an index from elements to sets."""

    def __init__(self, blobs: list[bytes]):
        self.sets = [np.frombuffer(x, U) for x in blobs]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        every, owners = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
        self.sketches = _parity(every, owners, len(self.sets))
        order = np.argsort(every, kind="stable")
        self.elements, self.owners = every[order], owners[order]

    def linked(self, pivot: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that are similar enough to pivot.

        Two sketches differ in no more bits than their sets in elements, so most sets are ruled out by a bit count.
        """
        total = self.sizes + len(pivot)
        apart = np.bitwise_count(self.sketches ^ _parity(pivot, np.zeros(len(pivot), np.int64), 1)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart * (100 + percent) <= (100 - percent) * total)
        if len(near) <= 64:
            shared = np.array([np.isin(pivot, self.sets[k], assume_unique=True, kind="sort").sum() for k in near], np.int64)
        else:
            i, j = np.searchsorted(self.elements, pivot), np.searchsorted(self.elements, pivot, side="right")
            n = j - i
            hits = self.owners[np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            shared = np.bincount(hits, minlength=len(self.sizes))[near]
        return near[(100 * shared >= percent * (total[near] - shared)) & (shared > 0)]


def _cluster(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Components inside whole families."""
        fam, sid, blobs = (table[c].to_pylist() for c in ("family", "sid", "elements"))
        groups: dict[int, list[int]] = {}
        for k, f in enumerate(fam):
            groups.setdefault(f, []).append(k)
        ids, labels = [], []
        for members in groups.values():
            own = _Family([blobs[k] for k in members])
            names = np.array([sid[k] for k in members])
            group, pivoted = np.arange(len(members)), np.zeros(len(members), dtype=bool)
            while True:
                sizes = np.bincount(group, minlength=len(members))
                open_ = np.flatnonzero(~pivoted & (group != sizes.argmax()))
                if not len(open_):
                    break
                pivoted[open_[0]] = True
                joined = np.unique(group[own.linked(own.sets[open_[0]], percent)])
                if len(joined) > 1:
                    group[np.isin(group, joined)] = joined[0]
            low = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(low, group, names)
            ids += names.tolist()
            labels += low[group].tolist()
        trim()
        return pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64())})

    return run


def _large_families(members: DataFrame, percent: int) -> DataFrame:
    """id, label for families in several parts (family, sid, elements, part, parts)."""
    state = materialize(members.select("family", "sid", "n", F.col("sid").alias("label"), F.lit(False).alias("pivoted")))

    def compare(own: pa.Table, pivots: pa.Table) -> pa.Table:
        a, b = [], []
        if own.num_rows and pivots.num_rows:
            part = _Family(own["elements"].to_pylist())
            labels = own["label"].to_numpy()
            for label, blob in zip(pivots["label"].to_pylist(), pivots["elements"].to_pylist(), strict=True):
                found = np.unique(labels[part.linked(np.frombuffer(blob, U), percent)])
                a += [label] * len(found)
                b += found.tolist()
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    turn = 0
    while True:
        sizes = state.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        outside = state.join(largest, "family").where(~F.col("pivoted") & (F.col("label") != F.col("largest"))).select("family", "sid", "n", "label")
        if outside.isEmpty():
            return state.select(F.col("sid").alias("id"), "label")
        # about so many for each family and round, so what a part is compared with stays bounded
        most = F.least(F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)]), F.lit(PIVOT_ELEMENTS) / F.avg("n"))
        left = outside.groupBy("family").agg((most / F.count(F.lit(1))).alias("share"))
        # the first of an order that changes with each round is always among them
        lowest = outside.groupBy("family").agg(F.min_by("sid", F.xxhash64("sid", F.lit(turn))).alias("sure"))
        chance = F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
        chosen = materialize(outside.join(left, "family").join(lowest, "family").where(chance | (F.col("sid") == F.col("sure"))).select("family", "sid", "label"))
        turn += 1
        sent = chosen.join(members.select("sid", "elements", "parts"), "sid").select("family", "label", "elements", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sent = sent.toDF(*sent.columns)  # both sides of the cogroup come from members
        own = members.join(state.select("sid", "label"), "sid").select("family", "part", "label", "elements")
        key = ["family", "part"]
        # many small groups with much to compute: spread them however few bytes they are
        own, sent = (d.repartition(4 * shuffle_width(d.sparkSession), *key) for d in (own, sent))
        links = own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(compare, "a long, b long")
        united = components(links).select(F.col("id").alias("label"), F.col("label").alias("new"))
        marked = state.join(chosen.select("sid", F.lit(True).alias("now")), "sid", "left").join(united, "label", "left")
        before, state = state, materialize(marked.select("family", "sid", "n", F.coalesce("new", "label").alias("label"), (F.col("pivoted") | F.coalesce("now", F.lit(False))).alias("pivoted")))
        discard(before, chosen)


def _surveyed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n, sid for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U)
            for i, j, b, off in texts(batch.column(2)):
                s, first = shingle_sets(b, off)
                n[i:j], sid[i:j] = np.diff(first), set_ids(s, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sid.view(np.int64))], ["doc_id", "mark", "n", "sid"])

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, sid long"))


def linked_sets(docs: DataFrame, rows: DataFrame, percent: int = 75) -> DataFrame:
    """id, label for every set that may have a link: sets of one component share the label."""
    if percent != 75:
        raise ValueError("bands and sketches are laid out for a similarity of 75 %")
    spark = docs.sparkSession
    elements = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_width(spark), int(elements // BUCKET) + 1)
    first = _keyed(docs, buckets).groupBy("bucket").applyInArrow(lambda t: _match(t, False), MATCHED)
    alive = materialize(first.groupBy("block").applyInArrow(_survivors, "sid long"))
    only = spark.sparkContext.broadcast(bloom.build(alive))
    again = _keyed(docs, buckets, only).groupBy("bucket").applyInArrow(lambda t: _match(t, True), MATCHED)
    rare = materialize(again.groupBy("block").applyInArrow(_rarest, "key long, a long, b long"))
    keyed = rare.where("key is not null").select("key", F.col("a").alias("b"))
    hubs = keyed.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a < last").select("key", "a")
    edges = keyed.join(hubs, "key").where("a <> b").select("a", "b").union(rare.where("key is null").select("a", "b"))
    families = materialize(components(edges).select(F.col("id").alias("sid"), F.col("label").alias("family")))
    discard(alive, rare)
    wanted = spark.sparkContext.broadcast(bloom.build(families.select("sid")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, b, off in texts(batch.column(0)):
                s, first = shingle_sets(b, off)
                sid = set_ids(s, first)
                for k in np.flatnonzero(bloom.contains(wanted.value, sid) & (sid != 0)):
                    if int(sid[k]) not in seen:
                        seen.add(int(sid[k]))
                        yield pa.RecordBatch.from_arrays([pa.array(sid[k : k + 1].view(np.int64)), pa.array([s[first[k] : first[k + 1]].tobytes()], pa.binary()), pa.array([int(first[k + 1] - first[k])])], ["sid", "elements", "n"])

    sets = docs.select("text").mapInArrow(fetch, "sid long, elements binary, n long").groupBy("sid").agg(F.first("elements").alias("elements"), F.first("n").alias("n"))
    members = stored = materialize(families.join(sets, "sid"))
    parts = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / PART), F.ceil(F.count(F.lit(1)) / PART_SETS)).cast("int").alias("parts"))
    members = members.join(parts, "family")
    whole = members.where("parts = 1").withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(4 * buckets)))
    small = materialize(whole.select("bucket", "family", "sid", "elements").groupBy("bucket").applyInArrow(_cluster(percent), "id long, label long"))
    large = materialize(members.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).select("family", "sid", "elements", "n", "part", "parts"))
    discard(stored, families)
    return small if large.isEmpty() else small.unionByName(_large_families(large, percent))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n, sid, component_id, node for every row; node is the component's own key."""
    rows = _surveyed(docs)
    labels = linked_sets(docs, rows)
    sets = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    nodes = materialize(sets.join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "low", F.coalesce("label", "sid").alias("node")))
    named = nodes.join(nodes.groupBy("node").agg(F.min("low").alias("component_id")), "node").select("sid", "node", "component_id")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)))
    spread = salted.where("n > 0").select("sid", "salt").distinct().join(named, "sid")
    return salted.join(spread, ["sid", "salt"], "left").select("doc_id", "mark", "n", "sid", "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    return _named(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one that names it; rows without shingles all stay.

    Of rows that repeat the kept identifier and text, one stays: the one whose other columns hash lowest.
    """
    known, lacks, text, one, salt, nth = free_names(docs.columns, "id", "lacks", "text", "one", "salt", "nth")
    named = materialize(_named(docs))
    keys = lambda row_id, mark: [F.coalesce(row_id, F.lit(0)).alias(known), F.isnull(row_id).alias(lacks), mark.alias(text)]
    low = F.min(F.struct(F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).max))), "mark", "doc_id"))
    stay = named.where("n > 0").groupBy("node").agg(low.alias("k")).select(*keys(F.col("k.doc_id"), F.col("k.mark")), F.lit(True).alias(one))
    empty = named.where("n = 0").select(*keys(F.col("doc_id"), F.col("mark")), F.lit(False).alias(one)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the join's partitioning serves the numbering too, so texts are shuffled once; rows without shingles are not numbered
    met = docs.select(*columns, *keys(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(stay.union(empty), [known, lacks, text])
    met = met.withColumn(salt, F.when(~F.col(one), F.monotonically_increasing_id()))
    order = F.xxhash64(*[c.cast("string") for c in columns])
    return met.withColumn(nth, F.row_number().over(Window.partitionBy(known, lacks, text, salt).orderBy(order))).where(F.col(nth) == 1).select(*columns)
