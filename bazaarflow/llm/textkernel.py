"""Vectorised text kernels over Arrow string buffers: words, word hashes, shingles, windows.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All hashes are unsigned 64 bit; equal word sequences have
equal hashes, different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
P, P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes of text that one step works on at a time; a longer document is a step of its own.
STEP = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x + U(P)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        wide = np.int64
    else:
        wide = np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about limit bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def trim() -> None:
    """Give freed memory back to the system: a worker process lives on and shares its executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each step: first and last document, its bytes, the documents' offsets in them."""
    data, offsets = buffers(col)
    for i, j in steps(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    trim()


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each document (one entry more than documents)."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 2, dtype=bool)
    edge[1:-1] = IS_WORD[b]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts, ends = edge[1:-1] & ~edge[:-2], edge[1:-1] & ~edge[2:]
    starts[inner] = edge[1:-1][inner]
    ends[inner - 1] = edge[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    lengths = ends - starts
    h = mix(eight[starts] & MASKS[np.minimum(lengths, 8)] ^ (lengths.astype(U) << U(56)))
    at, live = 8, np.flatnonzero(lengths > 8)
    while len(live):
        if at > 512:  # very long words, one by one
            for k in live:
                h[k] = U(int.from_bytes(__import__("hashlib").blake2b(b[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little"))
            break
        rest = lengths[live] - at
        h[live] = mix(h[live] * U(P) ^ (eight[starts[live] + at] & MASKS[np.minimum(rest, 8)]))
        at += 8
        live = live[rest > 8]
    return h


def sequences(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of width words that lies in one document, and the number of runs before each document.

    first: words before each document, as from words().
    """
    counts = np.maximum(np.diff(first) - width + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    n = len(h) - width + 1
    if n <= 0 or not before[-1]:
        return np.zeros(0, U), before
    if width <= 8:
        s = h[:n].copy()
        for k in range(1, width):
            s *= U(P)
            s += h[k : n + k]
    else:  # a rolling polynomial over prefix sums; P is odd and so has an inverse
        powers = np.full(len(h) + 1, U(P))
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(n, U(P_INVERSE))
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h * powers[:-1], dtype=U)])
        s = (sums[width:] - sums[:-width]) * inverse
    keep = np.repeat(first[:-1] - before[:-1], counts) + np.arange(before[-1])
    return mix(s[keep]), before


def shingle_sets(b: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the number of them before each document.

    A document of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    starts, ends, first = words(LOWER[b], off)
    h = word_hashes(LOWER[b], starts, ends)
    s, before = sequences(h, first, width)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(before))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] = whole[has] * U(P) + h[first[short][has] + k]
        s = np.concatenate([s, mix(whole ^ (counts[short].astype(U) << U(60)) ^ U(0x5DEECE66D))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(off)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s[i:j].sort()
    if len(s):
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[fresh], doc[fresh]
    return s, np.searchsorted(doc, np.arange(len(off)))
