"""SentencePiece encoding and decoding by a lattice of bounded-length substrings.

Each task splits its texts into units that no piece crosses (a run of spaces and what follows, a line break) and
handles each distinct unit once, all units of a step together and relation by relation: their substrings up to the
longest piece are exploded, equi-joined to the piece table by hash, grouped by unit, and folded from left to right. For a
unigram model the fold is Viterbi over the edges. For a byte-pair model the best path is not the one that the
library returns; there the fold repeats the best merge that the lattice has an edge for. Units, not documents, are the
lattice's keys, and nothing is shuffled. Characters without a piece become byte pieces.

Models with a normaliser other than identity are not supported.

Defined results: null and empty texts have no pieces and decode to the empty text; U+2581 counts as a space, so a text
that holds it decodes with spaces; rows without identifier and repeated rows are handled like any other; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import P_INVERSE, P, mix, texts, word_hashes

U = np.uint64
NONE = -1
#: Characters of a unit from which its merges are kept in a heap; units that a task remembers.
LONG, LIMIT = 48, 700_000


def prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over bytes, and the inverse powers: any substring's hash is one subtraction."""
    powers, inverse = np.full(len(b) + 1, U(P)), np.full(len(b) + 1, U(P_INVERSE))
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    return np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * mix(b.astype(U)) * powers[:-1], dtype=U)]), inverse


class Pieces:
    """The piece table of a model: hashes, scores, bytes."""

    def __init__(self, path: str, kind: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, n = kind, model.vocab_size()
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        text = [model.id_to_piece(k).replace("▁", " ").encode() for k in plain]
        self.longest = max(len(t.decode()) for t in text)
        self.split_lines = not any(b"\n" in t for t in text)
        hashes = []
        for t in text:
            sums, inverse = prefix_sums(np.frombuffer(t, np.uint8))
            hashes.append(sums[-1])
        hashes = mix(np.array(hashes, U))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, np.int32)[order]
        self.quick = np.zeros(1 << 22, dtype=bool)
        self.quick[(self.hashes >> U(42)).astype(np.int64)] = True
        self.scores = np.array([model.get_score(k) for k in range(n)])
        self.byte_ids = np.array([model.piece_to_id(f"<0x{k:02X}>") for k in range(256)], np.int32)
        raw = [b""] * n
        for k, t in zip(plain, text, strict=True):
            raw[k] = t
        for k, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([k])
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def lattice(self, b: np.ndarray, chars: np.ndarray, unit_end: np.ndarray) -> np.ndarray:
        """Piece of each substring: characters by length; chars are their first bytes and one end, unit_end the end of their unit."""
        sums, inverse = prefix_sums(b)
        n = len(chars) - 1
        out = np.full((n, self.longest), NONE, np.int32)
        at = np.arange(n)
        for length in range(1, self.longest + 1):
            at = at[at + length <= unit_end[at]]
            if not len(at):
                break
            h = mix((sums[chars[at + length]] - sums[chars[at]]) * inverse[chars[at]])
            maybe = np.flatnonzero(self.quick[(h >> U(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[k] == h[maybe]
            out[at[maybe[hit]], length - 1] = self.ids[k[hit]]
        return out


def fold_merges(edges: np.ndarray, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Last character of the piece that starts at each character (0: none starts); first: characters before each unit."""
    n, longest = edges.shape
    end = np.arange(1, n + 1)
    stop = np.repeat(first[1:], np.diff(first))
    score = np.where(edges >= 0, scores[edges], -np.inf)
    sizes = np.diff(first)
    for u in np.flatnonzero(sizes > LONG):
        _merge_one(score, end, int(first[u]), int(first[u + 1]))
    unit = np.repeat(np.arange(len(sizes)), sizes)
    live = np.flatnonzero((sizes <= LONG)[unit])
    while len(live):
        # every live segment with the one behind it
        follow = end[live]
        has = follow < stop[live]
        width = np.where(has, end[np.minimum(follow, n - 1)] - live, longest + 1)
        worth = np.where(has & (width <= longest), score[live, np.minimum(width, longest) - 1], -np.inf)
        own = unit[live]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        best = np.maximum.reduceat(worth, at)
        spans = np.diff(np.concatenate([at, [len(live)]]))
        top = (worth == np.repeat(best, spans)) & (worth > -np.inf)
        k = np.flatnonzero(top)
        k = k[np.concatenate([[True], own[k[1:]] != own[k[:-1]]])] if len(k) else k  # of equal ones the leftmost
        gone = end[live[k]]
        end[live[k]] = end[gone]
        end[gone] = 0
        open_ = np.repeat(best > -np.inf, spans)
        live = live[open_ & (end[live] > 0)]
    return end


def _merge_one(score: np.ndarray, end: np.ndarray, a: int, z: int) -> None:
    """The same for one long unit, with a heap."""
    longest, before, heap = score.shape[1], {k: k - 1 for k in range(a + 1, z)}, []

    def push(k: int) -> None:
        f = int(end[k])
        if f < z and (w := int(end[f]) - k) <= longest and score[k, w - 1] > -np.inf:
            heapq.heappush(heap, (-score[k, w - 1], k, f, int(end[f])))

    for k in range(a, z):
        push(k)
    while heap:
        _, k, f, e = heapq.heappop(heap)
        if end[k] != f or end[f] != e:
            continue
        end[k], end[f] = e, 0
        if e < z:
            before[e] = k
        push(k)
        if k > a:
            push(before[k])


def fold_viterbi(edges: np.ndarray, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same for the path of the highest sum of scores; a character without a piece costs 10 more than the worst piece."""
    n, longest = edges.shape
    score = np.where(edges >= 0, scores[edges], -np.inf)
    score[:, 0] = np.where(edges[:, 0] >= 0, score[:, 0], scores.min() - 10)
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    end = np.zeros(n, np.int64)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values = [0.0] + [-np.inf] * (z - a)
        for i in range(z - a):
            for w in range(1, min(longest, z - a - i) + 1):
                if values[i] + score[a + i, w - 1] > values[i + w]:
                    values[i + w], back[a + i + w] = values[i] + score[a + i, w - 1], i
        k = z - a
        while k:
            end[a + back[a + k]] = a + k
            k = int(back[a + k])
    return end


class Codec:
    def __init__(self, path: str, kind: str = "bpe"):
        self.table = Pieces(path, kind)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.at, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, fresh: list[bytes]) -> None:
        t = self.table
        b = np.frombuffer(b"".join(fresh), np.uint8)
        first_byte = np.concatenate([[0], np.cumsum([len(x) for x in fresh])])
        chars = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        first = np.searchsorted(chars, first_byte)
        edges = t.lattice(b, chars, np.repeat(first[1:], np.diff(first)))
        end = (fold_merges if t.kind == "bpe" else fold_viterbi)(edges, t.scores, first)
        starts = np.flatnonzero(end)
        piece = edges[starts, end[starts] - starts - 1]
        # a character without a piece takes one byte piece for each of its bytes
        n = np.where(piece >= 0, 1, chars[starts + 1] - chars[starts])
        place = np.cumsum(n) - n
        flat = np.repeat(piece, n)
        bare = np.flatnonzero(flat < 0)
        src = np.repeat(chars[starts] - place, n)[bare] + bare
        flat[bare] = t.byte_ids[b[src]]
        total = np.concatenate([[0], np.cumsum(n)])
        bounds = total[np.searchsorted(starts, first)]
        self.index.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + bounds[:-1]])
        self.counts = np.concatenate([self.counts, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after the other, and the number of ids before each."""
        if len(self.index) > LIMIT or len(self.flat) > 8 * LIMIT:
            self.clear()
        full = np.diff(off) > 0
        b = np.insert(b, off[:-1][full], 32)  # the space that every text is given in front
        off = off + np.concatenate([[0], np.cumsum(full)])
        if not len(b):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, line = b == 32, (b == 10) & self.table.split_lines
        begin = np.ones(len(b), dtype=bool)
        begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begin[off[:-1][full]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(b))
        _, at, inverse = np.unique(word_hashes(b, starts, ends), return_index=True, return_inverse=True)
        raw = b.tobytes()
        found = [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        which = list(map(self.index.get, found))
        if None in which:
            self.learn([w for w, k in zip(found, which, strict=True) if k is None])
            which = list(map(self.index.__getitem__, found))
        which = np.array(which, np.int64)[inverse]
        n = self.counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.at[which] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, off)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of the ids, without the space in front."""
        t = self.table
        n = t.sizes[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        raw = t.raw[np.repeat(t.raw_at[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        bounds = total[first].tolist()
        return [raw[i + (raw[i : i + 1] == b" ") : j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def codec_of(path: str, kind: str) -> Codec:
    """This worker process's table and unit memory, which outlive the task."""
    held = sys.__dict__.setdefault("_bazaarflow_pieces", {})
    if (path, kind) not in held:
        held[path, kind] = Codec(path, kind)
    return held[path, kind]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, model: str, kind: str = "bpe", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip and, if wanted, ids and decoded.

    model: a model file that every executor has; kind: bpe or unigram. ids_crc32 is over unsigned little-endian 32-bit ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, kind)
        for batch in batches:
            for i, j, b, off in texts(batch.column(1)):
                raw = b.tobytes()
                if b"\xe2\x96\x81" in raw:
                    own = [raw[x:y].replace(b"\xe2\x96\x81", b" ") for x, y in zip(off[:-1], off[1:], strict=True)]
                    source, spots = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own])])
                else:
                    source, spots = b, off
                ids, first = codec.encode(source, spots)
                text = codec.decode(ids, first)
                parts = [ids[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(first)),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
                    pa.array([t == raw[x:y] for t, x, y in zip(text, off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.bool_()),
                ]
                if with_ids:
                    columns += [pa.array([x.tolist() for x in parts], pa.list_(pa.int32())), pa.array([t.decode(errors="replace") for t in text], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")] + ["ids", "decoded"] * with_ids)

    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score of a model, as many rows as its vocabulary has."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(own.id_to_piece(k).replace("▁", " "), k, float(own.get_score(k))) for k in range(own.vocab_size()) if not (own.is_byte(k) or own.is_control(k) or own.is_unknown(k))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def relational_units(units: DataFrame, pieces: DataFrame, longest: int, kind: str = "bpe") -> DataFrame:
    """unit, spans (first and last character and id of each piece; a null id where a character has none) for distinct units.

    The lattice as relations: substrings up to the longest piece are exploded, joined to the piece table, grouped by unit and
    folded by a higher-order aggregate, Viterbi for a unigram model, best merges first for a byte-pair model.
    """
    starts = units.select("unit", F.length("unit").alias("n"), F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("a"))
    subs = starts.select("unit", "n", "a", F.explode(F.sequence(F.col("a"), F.least(F.col("n"), F.col("a") + longest - 1))).alias("z")).withColumn("piece", F.substring("unit", F.col("a"), F.col("z") - F.col("a") + 1))
    met = subs.join(F.broadcast(pieces), "piece", "left")  # a vocabulary has a fixed size
    edge = F.struct("z", "a", "score", "id")
    lattice = met.where("id is not null or a = z").groupBy("unit", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    worst = F.lit(-1e9)
    if kind == "unigram":
        state = F.array(F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("a"), F.lit(None).cast("int").alias("id")))

        def step(acc: Column, e: Column) -> Column:
            worth = F.get(acc, e["a"] - 1)["best"] + F.coalesce(e["score"], worst)
            here = F.struct(worth.alias("best"), e["a"].alias("a"), e["id"].alias("id"))
            known = F.get(acc, e["z"])
            return F.when(known.isNull(), F.array_append(acc, here)).when(worth > known["best"], F.concat(F.slice(acc, F.lit(1), e["z"]), F.array(here))).otherwise(acc)

        folded = lattice.withColumn("nodes", F.aggregate("edges", state, step))
        none = F.struct(F.col("n").alias("at"), F.array().cast("array<struct<a:int,z:int,id:int>>").alias("spans"))

        def back(acc: Column, _: Column) -> Column:
            node = F.get(F.col("nodes"), acc["at"])
            span = F.struct(node["a"].alias("a"), acc["at"].alias("z"), node["id"].alias("id"))
            return F.when(acc["at"] == 0, acc).otherwise(F.struct((node["a"] - 1).alias("at"), F.concat(F.array(span), acc["spans"]).alias("spans")))

        return folded.select("unit", F.aggregate(F.sequence(F.lit(1), F.col("n")), none, back)["spans"].alias("spans"))
    table = F.map_from_entries(F.transform("edges", lambda e: F.struct((e["a"] * 100_000 + e["z"]).alias("k"), F.struct(e["score"].alias("score"), e["id"].alias("id")).alias("v"))))
    found = lattice.withColumn("table", table)
    look = lambda a, z: F.try_element_at(F.col("table"), a * 100_000 + z)

    def merge(cuts: Column, _: Column) -> Column:
        """cuts: last characters of the segments, 0 in front; the best pair of neighbours, of equal ones the leftmost, loses the cut between them."""
        spots = F.when(F.size(cuts) > 2, F.sequence(F.lit(1), F.size(cuts) - 2)).otherwise(F.array().cast("array<int>"))
        best = F.array_max(F.transform(spots, lambda i: F.when(look(F.get(cuts, i - 1) + 1, F.get(cuts, i + 1))["id"].isNotNull(), F.struct(look(F.get(cuts, i - 1) + 1, F.get(cuts, i + 1))["score"].alias("score"), (-i).alias("i")))))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c, k: k != -best["i"]))

    cuts = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.sequence(F.lit(0), F.col("n")), merge)
    span = lambda z, k: F.struct((F.get(F.col("cuts"), k - 1) + 1).alias("a"), z.alias("z"), look(F.get(F.col("cuts"), k - 1) + 1, z)["id"].alias("id"))
    return found.withColumn("cuts", cuts).select("unit", F.filter(F.transform("cuts", span), lambda x: x["a"].isNotNull()).alias("spans"))


def encode_relational(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """doc_id, ids for every row of docs that has text, by joins over distinct units; the form that the README measures.

    Other rows, equal identifiers and U+2581 are treated as in encode_decode.
    """
    import sentencepiece

    own, pieces = sentencepiece.SentencePieceProcessor(model_file=model), piece_table(docs.sparkSession, model)
    longest = pieces.agg(F.max(F.length("piece"))).first()[0]
    by_byte = F.array(*[F.lit(own.piece_to_id(f"<0x{k:02X}>")) for k in range(256)])
    text = F.concat(F.lit(" "), F.replace("text", F.lit("▁"), F.lit(" ")))
    occurrences = docs.where("text <> ''").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.regexp_extract_all(text, F.lit(r"\n| *[^ \n]+| +"), F.lit(0))).alias("pos", "unit"))
    spans = relational_units(occurrences.select("unit").distinct(), pieces, longest, kind)

    def ids(x: Column) -> Column:
        raw = F.hex(F.encode(F.substring(F.col("unit"), x["a"], F.lit(1)), "utf-8"))
        byte = lambda k: F.get(by_byte, F.conv(F.substring(raw, k * 2 - 1, F.lit(2)), 16, 10).cast("int"))
        return F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), byte))

    coded = spans.select("unit", F.flatten(F.transform("spans", ids)).alias("ids"))
    met = occurrences.join(coded, "unit").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return met.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"))
