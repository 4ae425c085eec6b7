"""Sum-of-squares packing of tokenised documents into training sequences.

Each task packs the documents it reads, online: a document's tokens go to the open sequence for which the sum of squared
counts of partially filled sequences, kept in an array by fill level, ends up smallest. A document longer than a
sequence fills whole sequences first. When a task ends (or holds MAX_OPEN open sequences), the open ones whose fill is a
power of two are closed as they are; of the others, the emptiest are cut up to fill the fullest, and the last is cut into
powers of two: no sequence is padded. Nothing is shuffled and a task holds only its open sequences.

Defined results: null text is an empty document and still has the closing token; rows without identifier and repeated
rows are packed like any other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textkernel import texts, word_hashes, words

CAPACITY, CLOSING_ID, MAX_OPEN = 4096, 2, 2000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Texts of these characters only need no normalisation beyond lower case, and split by PIECE as the tokenizer splits them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Bytes that byte-level vocabularies write as another character.
BYTE_CHARS = {c: 256 + k for k, c in enumerate([*range(33), *range(127, 161), 173])}


class WordCodec:
    """Token ids by the word-level BPE tokenizer, which never joins across white space: each word is encoded once and
    remembered, by way of its pieces. Words with characters outside PLAIN go through the tokenizer as they are.

    The memory is emptied when it holds `limit` words or `limit_bytes` bytes of them.
    """

    def __init__(self, path: str, limit: int = 700_000, limit_bytes: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.limit_bytes = Tokenizer.from_file(path), limit, limit_bytes
        self.bare = Tokenizer(self.tokenizer.model)  # for pieces that are split and normalised already
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.at, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.bytes = 0

    def learn(self, fresh: list[bytes]) -> None:
        if len(self.pieces) > self.limit // 2:
            self.pieces = {}
        plain, odd, texts_ = {}, [], [w.decode() for w in fresh]
        for text in texts_:
            if PLAIN.fullmatch(text) and "<|" not in text:
                low = text.lower()
                plain[text] = [low] if low.isalpha() else PIECE.findall(low)
            else:
                odd.append(text)
        known = self.pieces
        lack = list({x for own in plain.values() for x in own if x not in known})
        for k in range(0, len(lack), 4096):
            part = lack[k : k + 4096]
            for x in part:
                known[x] = []
            code = self.bare.encode(" ".join([x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_CHARS) for x in part]), add_special_tokens=False)
            for word, token in zip(code.word_ids, code.ids, strict=True):
                known[part[word]].append(token)
        own = {x: y.ids for x, y in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True)} if odd else {}
        flat, counts = [], []
        for text in texts_:
            if text in plain:
                n = len(flat)
                for x in plain[text]:
                    flat += known[x]
                counts.append(len(flat) - n)
            else:
                flat += own[text]
                counts.append(len(own[text]))
        self.index.update(zip(fresh, range(len(self.counts), len(self.counts) + len(fresh)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts) - counts]) if counts else self.at
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.bytes += sum(map(len, fresh))

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, one after the other, and the number of ids before each."""
        if len(self.index) > self.limit or self.bytes > self.limit_bytes:
            self.clear()
        starts, stops, first = words(b, off)
        _, at, inverse = np.unique(word_hashes(b, starts, stops), return_index=True, return_inverse=True)
        raw = b.tobytes()
        found = [raw[i:j] for i, j in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        which = list(map(self.index.get, found))
        if None in which:
            self.learn([w for w, k in zip(found, which, strict=True) if k is None])
            which = list(map(self.index.__getitem__, found))
        which = np.array(which, np.int64)[inverse]
        n = self.counts[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.at[which] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[first]


def codec_of(path: str) -> WordCodec:
    """This worker process's word memory, which outlives the task."""
    held = sys.__dict__.setdefault("_bazaarflow_codecs", {})
    if path not in held:
        held[path] = WordCodec(path)
    return held[path]


class Packer:
    """Open sequences of one task, by fill level. A piece is (document's number, start, ids)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.levels, self.open, self.n_open = capacity, np.zeros(capacity + 1, np.int64), {}, 0

    def place(self, piece: tuple) -> list | None:
        """The sequence that this piece (of at most capacity ids) fills, if any."""
        size, top, n = len(piece[2]), self.capacity, self.levels
        if size == top:
            return [piece]
        # the change of the sum of squares, by the level that the piece goes on top of
        change = np.empty(top - size + 1, np.int64)
        change[0] = 2 * n[size] + 1
        change[1:] = 2 * (n[size + 1 : top + 1] - n[1 : top - size + 1]) + 2
        change[-1] -= 1
        change[1:][n[1 : top - size + 1] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
        if level:
            held = self.open[level].pop()
            n[level] -= 1
            held.append(piece)
        else:
            held = [piece]
            self.n_open += 1
        if level + size == top:
            self.n_open -= 1
            return held
        self.open.setdefault(level + size, []).append(held)
        n[level + size] += 1
        return None

    def drain(self) -> Iterator[list]:
        """Close every open sequence without padding."""
        rest = []
        for level in sorted(self.open, reverse=True):
            for held in self.open[level]:
                if level & (level - 1):
                    rest.append(held)
                else:
                    yield held
        self.levels[:], self.open, self.n_open = 0, {}, 0
        while rest:
            full = rest.pop(0)
            need = self.capacity - sum(len(x[2]) for x in full)
            while need and rest:
                piece = rest[-1].pop()
                doc, start, ids = piece
                if len(ids) > need:
                    rest[-1].append((doc, start + need, ids[need:]))
                    ids = ids[:need]
                full.append((doc, start, ids))
                need -= len(ids)
                if not rest[-1]:
                    rest.pop()
            if need:  # the last one
                left = self.capacity - need
                for bit in reversed(range(left.bit_length())):
                    if left >> bit & 1:
                        part, size = [], 1 << bit
                        while size:
                            doc, start, ids = full.pop(0)
                            if len(ids) > size:
                                full.insert(0, (doc, start + size, ids[size:]))
                                ids = ids[:size]
                            part.append((doc, start, ids))
                            size -= len(ids)
                        yield part
            else:
                yield full


def _rows(closed: list[tuple[int, list]], with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8)]
    for sequence, pieces in closed:
        offset = 0
        for doc, start, ids in pieces:
            doc_id, total = doc
            for column, value in zip(columns, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, ids), strict=True):
                column.append(value)
            offset += len(ids)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        return pa.RecordBatch.from_arrays([*arrays, pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32()))], [*names, "ids"])
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    tokenizer: a tokenizer file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the word memory makes many objects and no cycles
        codec, packer = None, Packer(capacity)
        sequence, closed, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            codec = codec or codec_of(tokenizer)
            doc_ids = batch.column(0).to_pylist()
            for i, _, b, off in texts(batch.column(1)):
                ids, ends = codec.encode(b, off)
                for k in range(len(ends) - 1):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(closing_id))
                    doc = (doc_ids[i + k], len(own))
                    for start in range(0, len(own), capacity):
                        if done := packer.place((doc, start, own[start : start + capacity])):
                            closed.append((sequence, done))
                            sequence += 1
                            held += len(done)
                    if packer.n_open >= MAX_OPEN:
                        for done in packer.drain():
                            closed.append((sequence, done))
                            sequence += 1
                    if held > 4000:
                        yield _rows(closed, with_ids)
                        closed, held = [], 0
        for done in packer.drain():
            closed.append((sequence, done))
            sequence += 1
        if closed:
            yield _rows(closed, with_ids)
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
