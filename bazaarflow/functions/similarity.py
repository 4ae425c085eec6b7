"""String similarity for entity resolution, on candidate pairs that native filters have cut down."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    # bit-parallel longest common subsequence: zero bits of the state mark matched positions
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one, which may begin or end outside it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    spans = lambda x, y: [y[max(0, k) : k + len(x)] for k in range(1 - len(x), len(y))]
    best = max(indel_ratio(a, s) for s in spans(a, b))
    return max(best, *(indel_ratio(b, s) for s in spans(b, a))) if len(a) == len(b) else best


def token_set_ratio(a: str, b: str) -> float:
    """What two texts' distinct words have in common against what each has beside it."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = bool(both)
    with_left, with_right = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = (len(left) + len(right)) * (1 - indel_ratio(left, right) / 100)
    found = [100 * (1 - apart / (with_left + with_right))]
    if both:
        found += [100 * (1 - (gap + len(left)) / (len(both) + with_left)), 100 * (1 - (gap + len(right)) / (len(both) + with_right))]
    return max(found)


def weighted_ratio(a: str, b: str) -> float:
    """The best of whole, word-wise and partial similarity, the latter two at a discount that grows with the texts' difference in length."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best, sort = indel_ratio(a, b), lambda t: " ".join(sorted(t.split()))
    if longer < 1.5:
        return max(best, 0.95 * max(indel_ratio(sort(a), sort(b)), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else partial_ratio(sort(a), sort(b))
    if not x & y:
        words = max(words, partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * words)


def nearest(label: str, official: list[str], least: float) -> str | None:
    """The first of the most similar official names, if similar enough."""
    scores = [weighted_ratio(label.lower(), x.lower()) for x in official]
    top = max(scores, default=0.0)
    return official[scores.index(top)] if official and top >= least else None


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " +")), " ")


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _ratio(sorted_tokens(a), sorted_tokens(b))


def may_reach(a: Column, b: Column, percent: int) -> Column:
    """False only for pairs below percent: an edit distance above (1 - percent / 100) of both lengths rules them out."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    most = F.floor((F.length(a) + F.length(b)) * (100 - percent) / 100).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)
