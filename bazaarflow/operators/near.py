"""Pairs of near names and sums over near names: no pair is missed, and equal keys find them where that is cheaper than comparing.

Two names that have a common subsequence of m characters both have it among what is left of them when all but m characters are
deleted. Blocks are cut by the lengths of the two names, which fix m, so few deletions are tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.similarity import indel_ratio

#: Names of a tile; two tiles are compared by one task where keys are too many.
TILE = 1_000
#: The same for sums, by the mean length of a block's names: up to the length given, then beyond it.
SUM_TILES, SHORT = (50_000, 10_000), 29
#: Keys and pairs that a task holds at once.
KEYS, PAIRS = 2_000_000, 1 << 18


@lru_cache(64)
def _picks(length: int, kept: int) -> np.ndarray:
    found = list(combinations(range(length), kept))
    return np.array(found, dtype=np.int32).reshape(len(found), kept)


def _codes(names: list[str]) -> np.ndarray:
    """A row of code points for each name; the names have one length."""
    return np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(names), -1)


def _key_rows(codes: np.ndarray, kept: int) -> np.ndarray:
    """For each row the 64-bit keys of all its subsequences of `kept` characters."""
    weights = np.arange(1, kept + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        weights = (weights ^ (weights >> np.uint64(shift))) * np.uint64(factor)
    picks, codes = _picks(codes.shape[1], kept), codes.astype(np.uint64)
    keys = np.zeros((len(codes), len(picks)), np.uint64)
    for k in range(kept):
        keys += codes[:, picks[:, k]] * (weights[k] | np.uint64(1))
    return keys.view(np.int64)


def subsequence_keys(names: list[str], kept: int) -> list[np.ndarray]:
    """Distinct 64-bit keys of all subsequences of `kept` characters, for names of one length."""
    out: list[np.ndarray] = []
    step = max(1, KEYS // comb(len(names[0]), kept))
    for at in range(0, len(names), step):
        out += [np.unique(row) for row in _key_rows(_codes(names[at : at + step]), kept)]
    return out


@F.pandas_udf(ArrayType(LongType()))
def _keys(name: pd.Series, kept: pd.Series) -> pd.Series:
    out: list[np.ndarray | None] = [None] * len(name)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, m) in enumerate(zip(name, kept, strict=True)):
        groups.setdefault((len(x), m), []).append(i)
    for (_, m), rows in groups.items():
        for i, found in zip(rows, subsequence_keys([name[i] for i in rows], int(m)), strict=True):
            out[i] = found
    return pd.Series(out, dtype=object)


def _ways(length: Column, kept: Column) -> Column:
    """How many subsequences of `kept` characters a name has, equal ones counted apart."""
    k = F.least(length - kept, kept)
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda total, i: total * (length - k + i) / i)


def candidates(names: DataFrame, kept: Callable[[Column, Column], Column], most: int = 5_000) -> DataFrame:
    """(block, x, y), each once, x before y: among them all names of one block with a common subsequence of kept(shorter, longer) characters.

    names: block, name, distinct and not null. Pairs of lengths with more than `most` ways to delete, and small blocks, are
    compared name by name, in tiles that many tasks share; the caller tests what comes out.
    """
    # few bytes and much work a row: numbers of partitions are fixed, or adaptive plans would merge them into one task
    many = 4 * names.sparkSession.sparkContext.defaultParallelism
    own = names.select("block", "name", F.length("name").alias("len")).repartition(many, "block", "name")
    counts = own.groupBy("block", "len").agg(F.count(F.lit(1)).alias("n"))
    a, b = (counts.select("block", F.col("len").alias(f"l{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    kinds = a.join(b, "block").where("la <= lb").withColumn("m", F.greatest(kept(F.col("la"), F.col("lb")), F.lit(0)).cast("int")).where("m <= la and m < lb")
    ways_a, ways_b = _ways(F.col("la"), F.col("m")), _ways(F.col("lb"), F.col("m"))
    cheap = (ways_a + ways_b <= most) & (F.col("na") * ways_a + F.col("nb") * ways_b < F.col("na").cast("double") * F.col("nb"))
    kinds = kinds.withColumn("keyed", cheap).withColumn("tiles", F.ceil(F.greatest("na", "nb") / TILE).cast("int"))
    # one row for each two lengths of a block: small, and a join by block would send a large block to one task
    shorter = own.join(F.broadcast(kinds.withColumnRenamed("la", "len").withColumn("la", F.col("len"))), ["block", "len"])
    longer = own.join(F.broadcast(kinds.withColumnRenamed("lb", "len").withColumn("lb", F.col("len"))), ["block", "len"])

    columns = ["block", "la", "lb"]
    sides = shorter.where("keyed").select(*columns, "m", "name").unionByName(longer.where("keyed and la < lb").select(*columns, "m", "name"))
    met = sides.select(*columns, "name", F.explode(_keys("name", "m")).alias("key")).groupBy(*columns, "key").agg(F.collect_list("name").alias("own")).where(F.size("own") > 1)
    pairs = met.select(*columns, F.explode("own").alias("x"), "own").select(*columns, "x", F.explode("own").alias("y")).where("x < y")
    by_key = pairs.where((F.least(F.length("x"), F.length("y")) == F.col("la")) & (F.greatest(F.length("x"), F.length("y")) == F.col("lb"))).select("block", "x", "y").distinct()

    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = shorter.where("not keyed").select(*columns, F.col("name").alias("x"), tile(F.col("name")).alias("p"), every.alias("q"))
    right = longer.where("not keyed").select(*columns, F.col("name").alias("y"), tile(F.col("name")).alias("q"), every.alias("p"))
    ordered = (F.col("la") < F.col("lb")) | (F.col("x") < F.col("y"))
    cell = [*columns, "p", "q"]
    by_tile = left.repartition(many, *cell).join(right.repartition(many, *cell).hint("shuffle_hash"), cell).where(ordered).select("block", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return by_key.unionByName(by_tile)


def _masks(a: np.ndarray, letters: int) -> np.ndarray:
    """For each row and letter the words of 64 bits that mark its positions."""
    n, length = a.shape
    masks, row = np.zeros((n * letters, (length + 63) // 64), np.uint64), np.arange(n) * letters
    for k in range(length):
        masks[row + a[:, k], k // 64] |= np.uint64(1 << k % 64)
    return masks


def _common(masks: np.ndarray, letters: int, length: int, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows i (given by their masks) and rows j of b: similarity.indel_ratio for many pairs."""
    words = masks.shape[1]
    state = [np.full(len(i), (1 << min(64, length - 64 * w)) - 1, np.uint64) for w in range(words)]
    row = i * letters
    for k in range(b.shape[1]):
        at, carry = row + b[:, k][j], None
        for w in range(words):
            mask, old = masks[:, w][at], state[w]
            hit = old & mask
            total = old + hit
            over = total < old
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64) if words > 1 else None
            state[w] = total | (old ^ hit)
    kept = [np.bitwise_count(v & np.uint64((1 << min(64, length - 64 * w)) - 1)) for w, v in enumerate(state)]
    return length - np.sum(kept, axis=0, dtype=np.int64)


def _grid(rows: int, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, PAIRS // columns)
    for at in range(0, rows, step):
        n = min(step, rows - at)
        yield np.repeat(np.arange(at, at + n), columns), np.tile(np.arange(columns), n)


def _flat(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct keys, and their rows."""
    keys = np.sort(keys, axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys[new], np.repeat(np.arange(len(keys)), new.sum(axis=1))


def _sorted_keys(rows: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row in order of keys, their places in order of rows, and the rows in that order."""
    keys, row = _flat(_key_rows(rows, kept))
    order = np.argsort(keys)
    return keys[order], order, row


def _by_keys(a: np.ndarray, b: np.ndarray, keys: tuple[np.ndarray, np.ndarray, np.ndarray], kept: int, ahead: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), each once: rows of a, which have these sorted keys, and of b that share a key; with `ahead` only j + ahead > i."""
    (own, place, i), (other, order, j) = keys, _sorted_keys(b, kept)
    j = j[order]
    low, n = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    low[place] = np.searchsorted(other, own)
    n[place] = np.searchsorted(other, own, "right")
    n -= low
    if n.sum() > 4 * len(a) * len(b):
        yield from _grid(len(a), len(b))
        return
    # whole rows of a, so that all meetings of a pair are in one stretch
    ends = np.cumsum(np.bincount(i, n, len(a))).astype(np.int64)
    first = np.searchsorted(i, np.arange(len(a) + 1))
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * PAIRS, "right")))
        part = slice(first[at], first[end])
        many = n[part]
        left = np.repeat(i[part], many)
        right = j[np.repeat(low[part] - np.cumsum(many) + many, many) + np.arange(len(left))]
        pairs = left * len(b) + right
        if ahead is not None:
            pairs = pairs[right + ahead > left]
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        for k in range(0, len(pairs), PAIRS):
            yield np.divmod(pairs[k : k + PAIRS], len(b))
        at = end


def near_rows(a: np.ndarray, b: np.ndarray, kept: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), each once: rows of a and b with a common subsequence of `kept` code points; with `same`, b is a and j comes after i.

    What all rows begin or end with is left out first: some longest common subsequence has it.
    """
    length, other = a.shape[1], b.shape[1]
    head, tail, short = 0, 0, min(length, other)
    while head < short and (a[:, head] == a[0, head]).all() and (b[:, head] == a[0, head]).all():
        head += 1
    while tail < short - head and (a[:, -1 - tail] == a[0, -1 - tail]).all() and (b[:, -1 - tail] == a[0, -1 - tail]).all():
        tail += 1
    a, b, kept = a[:, head : length - tail], b[:, head : other - tail], kept - head - tail
    (n, length), (m, other) = a.shape, b.shape
    letters = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    a, b = np.searchsorted(letters, a), np.asfortranarray(np.searchsorted(letters, b))
    step, width = max(1, KEYS // max(1, len(letters) * ((length + 63) // 64))), m
    keyed = False
    if kept > 0 and max(ways := [comb(length, kept), comb(other, kept)]) <= KEYS:
        rows, columns = max(1, KEYS // ways[0]), max(1, KEYS // ways[1])
        # about as many nanoseconds as a key and a compared character took
        keyed = (min(n, rows) * ways[0] + min(m, columns) * ways[1]) * (200 + 7 * kept) < 20.0 * min(n, rows) * min(m, columns) * other
        if keyed:
            step, width = min(step, rows), columns
    for p in range(0, n, step):
        part = a[p : p + step]
        masks = _masks(part, len(letters)) if kept > 0 else None
        keys = _sorted_keys(part, kept) if keyed else None
        for q in range(0, m, width):
            if same and min(q + width, m) <= p + 1:
                continue
            stretch = b[q : q + width]
            for i, j in _by_keys(part, stretch, keys, kept, q - p if same else None) if keyed else _grid(len(part), len(stretch)):
                if same:
                    later = j + (q - p) > i
                    i, j = i[later], j[later]
                if kept > 0:
                    near = _common(masks, len(letters), length, stretch, i, j) >= kept
                    i, j = i[near], j[near]
                yield i + p, j + q


def cell_sums(left: list[str], right: list[str] | None, weights: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each name the sums of the weights (rows: names) of the other side's near names; without a right side, of the others of the left.

    Names are distinct, and near with an indel ratio of at least `least`.
    """
    same = right is None
    other = left if same else right
    sums = np.zeros(weights[0].shape, np.int64), np.zeros(weights[1].shape, np.int64)
    by_length: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    for own, names in zip(by_length, (left, other), strict=True):
        for k, name in enumerate(names):
            own.setdefault(len(name), []).append(k)
    sides = [{n: (np.array(rows), _codes([names[k] for k in rows])) for n, rows in own.items()} for own, names in zip(by_length, (left, other), strict=True)]
    for la, (rows, a) in sides[0].items():
        for lb, (columns, b) in sides[1].items():
            kept = -(-(la + lb) * least // 200)
            if kept > min(la, lb) or same and (lb < la or la == lb and len(rows) == 1):
                continue
            for i, j in near_rows(a, b, kept, same and la == lb):
                for w in range(weights[0].shape[1]):
                    # counts far below 2^53 are exact in the floats of bincount
                    sums[0][rows, w] += np.bincount(i, weights[1][columns[j], w], len(rows)).astype(np.int64)
                    sums[1][columns, w] += np.bincount(j, weights[0][rows[i], w], len(columns)).astype(np.int64)
    return (sums[0] + sums[1], sums[1]) if same else sums


def _few_sums(names: list[str], weights: np.ndarray, least: int) -> np.ndarray:
    sums = np.zeros(weights.shape, np.int64)
    for i, j in combinations(range(len(names)), 2):
        if indel_ratio(names[i], names[j]) >= least:
            sums[i] += weights[j]
            sums[j] += weights[i]
    return sums


def near_sums(names: DataFrame, by: list[str], weights: list[str], least: int = 90) -> DataFrame:
    """by, name, and for each weight its sum over the near names of the same block; names without any may be left out.

    names: by, name, weights (whole numbers), distinct by block and name and not null; near is an indel ratio of at least `least`.
    Large blocks are cut into tiles by a hash of the name. A task compares two tiles at a time and gives sums, so pairs are neither
    shuffled nor stored, and its memory holds two tiles' names beside a bounded number of keys and pairs.
    """
    many = 4 * names.sparkSession.sparkContext.defaultParallelism
    names = names.select(*by, "name", *[F.col(w).cast("long").alias(w) for w in weights]).repartition(many, *by, "name")
    size = F.when(F.avg(F.length("name")) <= SHORT, SUM_TILES[0]).otherwise(SUM_TILES[1])
    # few rows: each stands for more than a tile of names
    large = names.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_tiles")).where("_tiles > 1")
    tiled = names.join(F.broadcast(large), by, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1))).withColumn("_t", F.pmod(F.xxhash64("name"), F.col("_tiles")).cast("int"))
    met = tiled.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    keys = [*by, "_p", "_q"]
    cells = met.select(*by, F.least("_t", "_u").alias("_p"), F.greatest("_t", "_u").alias("_q"), (F.col("_t") <= F.col("_u")).alias("_left"), "name", *weights)
    cells = cells.repartition(many, *keys).sortWithinPartitions(*keys)

    def key(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(c)[row].as_py() for c in keys]

    def cell(parts: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(parts)
        all_names, values = table["name"].to_pylist(), np.column_stack([table[w].to_numpy() for w in weights])
        if len(all_names) == 1:
            return table.select([*by, "name", *weights]).slice(0, 0)
        if table["_p"][0] == table["_q"][0]:
            sums = _few_sums(all_names, values, least) if len(all_names) <= 12 else cell_sums(all_names, None, (values, values), least)[0]
        else:
            is_left = table["_left"].to_numpy()
            sides = [np.flatnonzero(is_left), np.flatnonzero(~is_left)]
            sums = np.zeros(values.shape, np.int64)
            if len(sides[0]) and len(sides[1]):
                sums[sides[0]], sums[sides[1]] = cell_sums([all_names[k] for k in sides[0]], [all_names[k] for k in sides[1]], (values[sides[0]], values[sides[1]]), least)
        out = table.select([*by, "name"])
        for k, w in enumerate(weights):
            out = out.append_column(w, pa.array(sums[:, k]))
        return out.filter(pa.array(sums.any(axis=1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.zeros(batch.num_rows, bool)
            for c in keys:
                column = batch.column(c)
                cuts[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
            at = 0
            for cut in np.flatnonzero(cuts):
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                done.append(cell(held))
                held, at = [], cut
                if sum(t.num_rows for t in done[-64:]) > 10_000 or len(done) > 1_000:
                    yield from pa.concat_tables(done).combine_chunks().to_batches(20_000)
                    done = []
            held.append(batch.slice(at))
        if held:
            done.append(cell(held))
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches(20_000)

    types = dict(cells.dtypes)
    found = cells.mapInArrow(compare, ", ".join(f"`{c}` {types[c]}" for c in [*by, "name", *weights]))
    return found.groupBy(*by, "name").agg(*[F.sum(w).alias(w) for w in weights])
