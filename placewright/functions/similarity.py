"""Similarity of short texts as column functions.

``ratio`` is the normalised indel similarity 2 * LCS / (length + length), which
Spark has not; the longest common subsequences of a batch of pairs are worked
out together in arrays, equal pairs once: use it on retrieved pairs, not on
cross products.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a table of pairs that is worked on at a time, but for a longer pair.
MOST = 1 << 21


def normalize(c: Column) -> Column:
    """Words of a-z and 0-9, joined by single spaces."""
    return F.array_join(tokens(c), " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _table(texts: Sequence[str], pad: int) -> np.ndarray:
    """Code points of texts, a row each, filled up with ``pad``."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(texts), max(int(size.max(initial=0)), 1)), pad, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = points
    return out


def _shared(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs.

    Bit-parallel: the places of the right text are bits of words, all set at first;
    each character of the left text adds the places that it matches, and as many
    bits are cleared as the subsequence is long.
    """
    x, y = _table(left, 0xFFFFFFFF), _table(right, 0xFFFFFFFE)
    width = -(-y.shape[1] // 64) * 64
    y = np.pad(y, ((0, 0), (0, width - y.shape[1])), constant_values=0xFFFFFFFE)
    rest = np.full((len(left), width // 64), ~np.uint64(0))
    for i in range(x.shape[1]):
        match = np.packbits(y == x[:, i : i + 1], axis=1, bitorder="little").view(np.uint64)
        carry = np.zeros(len(left), np.uint64)
        for w in range(match.shape[1]):
            v, m = rest[:, w].copy(), match[:, w]
            added = v + (v & m)
            over = added < v
            total = added + carry
            carry = (over | (total < added)).astype(np.uint64)
            rest[:, w] = total | (v & ~m)
    return width - np.bitwise_count(rest).sum(axis=1).astype(np.int64)


def shared_of(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The same for pairs of any lengths: those of like length together, in tables of bounded size."""
    cost = np.fromiter((max(len(x), len(y), 1) for x, y in pairs), np.int64, len(pairs))
    order, out, begin = np.argsort(cost, kind="stable"), np.zeros(len(pairs), np.int64), 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end - begin + 1) * (int(cost[order[end]]) + 64) <= MOST:
            end = min(len(order), end + 256)
        own = order[begin:end]
        out[own] = _shared([pairs[i][0] for i in own], [pairs[i][1] for i in own])
        begin = end
    return out


def indels(pairs: list[tuple[str, str]]) -> list[float]:
    """2 * LCS / (length + length) of each pair, 1 for equal texts."""
    unlike = {p for p in pairs if p[0] != p[1]}
    asked = list(unlike)
    known = {p: 2.0 * n / (len(p[0]) + len(p[1])) for p, n in zip(asked, shared_of(asked).tolist())}
    return [known.get(p, 1.0) for p in pairs]


def most(rows: list[list[tuple[str, str]]]) -> pd.Series:
    """The greatest indel similarity of each row's pairs, 0 for none."""
    values = iter(indels([p for row in rows for p in row]))
    return pd.Series([max((next(values) for _ in row), default=0.0) for row in rows], dtype="float64")


# Inputs of these hold no lambda functions: Spark does not always find such a call again where it is used twice.
@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity, 0 for nulls."""
    return most([[(x, y)] if x is not None and y is not None else [] for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def _indel_of_any(values: pd.Series, b: pd.Series) -> pd.Series:
    """The greatest indel similarity of a normal text with any of the texts of an array, 0 for nulls."""
    return most([[(" ".join(re.findall("[a-z0-9]+", v.lower())), y) for v in vs if v] if vs is not None and y is not None else [] for vs, y in zip(values, b)])


@F.pandas_udf(T.DoubleType())
def _indel_of_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best of common words, common and left words, common and right words of two sets, 0 for empty ones or nulls."""

    def pairs(x: set[str], y: set[str]) -> list[tuple[str, str]]:
        common, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
        if common and not (left and right):
            return [(common, common)]
        whole = f"{common} {left}".strip(" "), f"{common} {right}".strip(" ")
        return [whole, (common, whole[0]), (common, whole[1])] if common else [whole]

    return most([pairs(set(x), set(y)) if x is not None and y is not None and len(x) and len(y) else [] for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def _best_window(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best indel similarity of the shorter text with any window of its length in the longer, windows cut at the edges included; 0 for nulls."""
    asked = [(x, y) if len(x) <= len(y) else (y, x) for x, y in ((x or "", y or "") for x, y in zip(a, b))]
    known = {(s, t): float(not t) if not s else 1.0 for s, t in asked if s in t}
    rest = [p for p in dict.fromkeys(asked) if p not in known]
    for begin in range(0, len(rest), 512):
        own = rest[begin : begin + 512]
        windows = [[(s, w) for w in {*(t[:j] for j in range(1, len(s))), *(t[i : i + len(s)] for i in range(len(t)))}] for s, t in own]
        values = iter(indels([p for ws in windows for p in ws]))
        known |= {p: max(next(values) for _ in ws) for p, ws in zip(own, windows)}
    return pd.Series([known[p] for p in asked], dtype="float64").where(a.notna() & b.notna(), 0.0)


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(shared_of([(x or "", y or "") for x, y in zip(a, b)]), dtype="int64")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return F.when(a.isNotNull() & b.isNotNull(), _lcs(a, b))


def indel(a: Column, b: Column) -> Column:
    """2 * LCS / (length + length) of two texts as they are."""
    return F.when(a.isNotNull() & b.isNotNull(), _indel(a, b))


def some(a: Column) -> Column:
    """Whether there is a text."""
    return F.length(F.coalesce(a, F.lit(""))) > 0


def ratio(a: Column, b: Column) -> Column:
    return _indel(F.when(some(a) & some(b), normalize(a)), normalize(b))


def best_ratio(values: Column, b: Column) -> Column:
    """The greatest ratio of a text with any of an array, 0 for none."""
    return _indel_of_any(values, F.when(some(b), normalize(b)))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter text with any window of its length in the longer, windows cut at the edges included."""
    both_some = some(a) & some(b)
    return _best_window(F.when(both_some, normalize(a)), F.when(both_some, normalize(b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    join = lambda c: F.array_join(F.array_sort(tokens(c)), " ")
    return _indel(F.when(some(a) & some(b), join(a)), join(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of common words, common and left words, common and right words; 1 if one set holds the other."""
    return _indel_of_sets(F.when(some(a) & some(b), F.array_distinct(tokens(a))), F.array_distinct(tokens(b)))


def common_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def token_overlap(a: Column, b: Column) -> Column:
    """Common words as a share of the left text's."""
    n = F.size(F.array_distinct(tokens(a)))
    return F.when(n == 0, 0.0).otherwise(common_tokens(a, b) / n)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(n == 0, 0.0).otherwise(common_tokens(a, b) / n)


def exact_match(a: Column, b: Column) -> Column:
    """Equal words, some of them: texts without any a-z or 0-9 don't match."""
    return F.coalesce((normalize(a) == normalize(b)) & (normalize(a) != ""), F.lit(False))


def prefix_affinity(a: Column, b: Column) -> Column:
    """Length of the common beginning, as a share of the longer text."""
    x, y = normalize(a), normalize(b)
    n = F.least(F.length(x), F.length(y))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))), i).otherwise(s))
    return F.when(n == 0, 0.0).otherwise(shared / F.greatest(F.length(x), F.length(y)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))
