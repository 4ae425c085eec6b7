"""Secret scan: fixed patterns, and further candidates judged by who owns them in the whole corpus.

Three base patterns always count. Further candidates (well-known token formats, high-entropy strings outside base spans) are
hashed, and the hashes are aggregated over the corpus by distinct repositories and owners: a value that many owners or
many repositories carry is a copied example, one that few carry and that looks live is reported. Values are shuffled as digests
only, distinct per owner before the shuffle; answers return by (value, salt), so a value that a third of all rows
carry is spread.

Defined results: null text is empty and has no spans; a null repository or owner counts as one of its own name; repeated
rows are judged one by one (their values have the same owners); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_whole, materialize
from .textkernel import LOWER, texts

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KNOWN = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----")
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
EXAMPLE = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234567|abcdef")
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "known", "entropy")
MAX_OWNERS, MAX_REPOS, MIN_BITS, SALTS = 2, 3, 3.5, 64

_CLASS = np.zeros(256, dtype=bool)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True

SPAN = "struct<start:long,rank:int,stop:long>"
SCHEMA = f"row long, doc_id long, repo string, owner string, base array<{SPAN}>, more array<struct<start:long,rank:int,stop:long,value:binary,live:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def bits(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, bool]]:
    """(start, rank, end, value, looks live) of candidates outside the base spans."""
    found, starts, stops = [], [], []
    for a, _, z in base:  # what they cover, as intervals that do not touch each other
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], z)
        else:
            starts.append(a)
            stops.append(z)
    for rank, pattern in ((3, KNOWN), (4, RANDOM)):
        for m in pattern.finditer(text):
            a, z, value = m.start(), m.end(), m[0]
            k = bisect_left(starts, z)  # the last interval that begins before the end is the only one that can overlap
            if k and stops[k - 1] > a:
                continue
            if rank == 4 and (sum(c.isdigit() for c in value) < 3 or sum(c.isalpha() for c in value) < 3 or bits(value) < MIN_BITS):
                continue
            starts.insert(k, a)
            stops.insert(k, z)
            found.append((a, rank, z, value, not EXAMPLE.search(value)))
    return sorted(found)


def suspects(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents of a step that can hold a span; all others hold none."""
    raw, low, at = b.tobytes(), LOWER[b].tobytes(), []
    for text, words in ((low, KEYWORDS), (raw, (b"AKIA", b"-----BEGIN", b"xox", b"eyJ", b"gh", b"sk_live_"))):
        for word in words:
            k = text.find(word)
            while k >= 0:
                at.append(k)
                k = text.find(word, k + len(word))
    edge = np.zeros(len(b) + 2, dtype=np.int8)
    edge[1:-1] = _CLASS[b]
    change = np.diff(edge)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = (ends - starts) >= 20
    doc = lambda k: np.searchsorted(off, k, side="right") - 1
    first, last = doc(starts[long]), doc(ends[long] - 1)
    across = [np.arange(x, y) for x, y in zip(first, last, strict=True) if x < y]  # a run may cross documents
    return np.unique(np.concatenate([doc(np.array(at, np.int64)), last, *across]))


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row per row of docs: its base spans and its further candidates with their values' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, base, more = batch.num_rows, [[]] * batch.num_rows, [[]] * batch.num_rows
            for i, _, b, off in texts(batch.column(1)):
                for k in suspects(b, off).tolist():
                    text = b[off[k] : off[k + 1]].tobytes().decode()
                    spans = base_spans(text)
                    base[i + k] = [{"start": x, "rank": r, "stop": y} for x, r, y in spans]
                    more[i + k] = [{"start": x, "rank": r, "stop": y, "value": hashlib.sha256(v.encode()).digest()[:16], "live": live} for x, r, y, v, live in further_spans(text, spans)]
            kinds = [pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(base, kinds[0]), pa.array(more, kinds[1])], ["row", "doc_id", "repo", "owner", "base", "more"])
            row += n

    return docs.select("doc_id", "text", repo.cast("string").alias("repo"), owner.cast("string").alias("owner")).mapInArrow(run, SCHEMA)


def ownership(candidates: DataFrame) -> DataFrame:
    """value, repos, owners, uses: how widely each candidate value is spread over the corpus.

    Both numbers of distinct names are counted in two steps, so no task holds the names of one value.
    """
    each = candidates.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("uses"))
    repos = each.groupBy("value", "repo").agg(F.sum("uses").alias("uses")).groupBy("value").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    return repos.join(owners, "value").select("value", "repos", "owners", "uses")


def find_secrets(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared.

    n_live and n_shared count further candidates that were reported, and those that were not: more than max_owners owners or
    max_repos repositories carry the value, or it looks like an example.
    """
    rows = materialize(scan(docs, F.lit("") if repo is None else repo, F.lit("") if owner is None else owner))
    found = rows.where(F.size("more") > 0).select("row", "repo", "owner", F.explode("more").alias("c")).select("row", "repo", "owner", "c.*").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    spread = found.select("value", "salt").distinct().join(ownership(found), "value").select("value", "salt", "repos", "owners")
    judged = found.join(spread, ["value", "salt"]).withColumn("reported", F.col("live") & (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    added = judged.groupBy("row").agg(F.collect_list(F.when(F.col("reported"), F.struct("start", "rank", "stop"))).alias("added"), F.count_if(~F.col("reported")).alias("n_shared"))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    extra = F.coalesce(F.col("added"), F.array().cast(f"array<{SPAN}>"))
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.size(extra).cast("long").alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
    )


def redact(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every reported span replaced by mask, and n_chars, where there is one, set anew; all rows and columns stay.

    Rows that share an identifier are told apart by their text; rows without identifier are met by their text alone.
    """
    key, hit = free_names(docs.columns, "row_id", "row_spans")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, F.xxhash64(F.struct("doc_id", F.xxhash64("text"))).alias(key))
    repo, owner = (F.lit("") if c is None else c for c in (repo, owner))
    scanned = keyed.select(F.col(key).alias("doc_id"), "text", repo.alias("repo"), owner.alias("owner"))
    spans = find_secrets(scanned, F.col("repo"), F.col("owner"))
    hits = spans.where("spans <> ''").groupBy(F.col("doc_id").alias(key)).agg(F.first("spans").alias(hit))

    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(batch.num_columns - 1)
            text_, n = batch.column(at), None
            if marks.null_count < len(marks):
                new = text_.to_pylist()
                n = batch.column(chars).to_pylist() if chars >= 0 else None
                for k, own in enumerate(marks.to_pylist()):
                    if own:
                        out, last = [], 0
                        for start, stop in sorted(tuple(map(int, x.split(":")[1:])) for x in own.split(",")):
                            if start >= last:
                                out += [new[k][last:start], mask]
                            last = max(last, stop)
                        new[k] = "".join([*out, new[k][last:]])
                        if n:
                            n[k] = len(new[k])
                text_ = pa.array(new, text_.type)
            columns = [text_ if k == at else pa.array(n, c.type) if k == chars and n else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns[:-1], batch.schema.names[:-1])

    return keyed.join(hits, key, "left").select(*columns, hit).transform(map_whole, cut, docs.schema)
