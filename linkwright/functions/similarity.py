"""Similarities of strings and token lists in [0, 1]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _empty_cases(a_empty: Column, b_empty: Column, otherwise: Column, both: float = 1.0) -> Column:
    return F.when(a_empty & b_empty, F.lit(both)).when(a_empty | b_empty, F.lit(0.0)).otherwise(otherwise)


def jaccard(a: Column, b: Column) -> Column:
    return _empty_cases(F.size(a) == 0, F.size(b) == 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return _empty_cases(F.size(a) == 0, F.size(b) == 0, F.size(F.array_intersect(a, b)) / least)


def levenshtein(a: Column, b: Column) -> Column:
    return _empty_cases(a == "", b == "", 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix by that of the longer one; 0 if either is empty."""
    short = F.least(F.length(a), F.length(b))
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(common / F.greatest(F.length(a), F.length(b)))


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row per text, filled up with -1; lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(int(sizes.max(initial=0)), 1)), -1, np.int32)
    if sizes.sum():
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    return out, sizes


def jaro_winkler_of(a: list[str], b: list[str]) -> np.ndarray:
    """All pairs of a batch at once, a step per character; prefixes count from a Jaro similarity over 0.7 on."""
    x, n = _matrix(a)
    y, m = _matrix(b)
    rows = np.arange(len(a))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    free = np.arange(y.shape[1])[None, :] < m[:, None]
    mine = np.zeros(x.shape, bool)
    column = np.arange(y.shape[1])[None, :]
    for i in range(x.shape[1]):
        near = free & (y == x[:, i, None]) & (np.abs(column - i) <= reach[:, None]) & (i < n)[:, None]
        hit = near.any(axis=1)
        free[rows[hit], near.argmax(axis=1)[hit]] = False
        mine[hit, i] = True
    taken = (column < m[:, None]) & ~free
    matches = mine.sum(axis=1)
    width = max(int(matches.max(initial=0)), 1)
    left, right = (np.full((len(a), width), -1) for _ in range(2))
    for flags, source, out in ((mine, x, left), (taken, y, right)):
        r, c = np.nonzero(flags)
        out[r, (np.cumsum(flags, axis=1) - 1)[r, c]] = source[r, c]
    half = (left != right).sum(axis=1) // 2
    k = np.maximum(matches, 1)
    jaro = np.where(matches > 0, (matches / np.maximum(n, 1) + matches / np.maximum(m, 1) + (matches - half) / k) / 3, 0.0)
    w = min(4, x.shape[1], y.shape[1])
    same = np.cumprod((x[:, :w] == y[:, :w]) & (x[:, :w] >= 0), axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
    return np.where((n == 0) & (m == 0), 1.0, np.where((n == 0) | (m == 0), 0.0, out))


def longest_common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    x, n = _matrix(a)
    y, m = _matrix(b)
    before = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        own = i < n
        step = np.where((y == x[:, i, None]) & own[:, None] & (y >= 0), before[:, :-1] + 1, before[:, 1:])
        before[:, 1:] = np.maximum.accumulate(step, axis=1)
    return before[np.arange(len(a)), m]


_BLOCK = 4096


def _in_blocks(f, a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairs by length, so that a long string widens the matrix of its own block alone."""
    x, y = [v or "" for v in a], [v or "" for v in b]
    order = np.argsort([len(s) + len(t) for s, t in zip(x, y)], kind="stable")
    out = np.zeros(len(x))
    for at in range(0, len(x), _BLOCK):
        some = order[at : at + _BLOCK]
        out[some] = f([x[i] for i in some], [y[i] for i in some])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_blocks(jaro_winkler_of, a, b)


def _indel(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(s) + len(t) for s, t in zip(a, b)])
    either = np.array([not s or not t for s, t in zip(a, b)])
    return np.where(total == 0, 1.0, np.where(either, 0.0, 2 * longest_common_subsequence(a, b) / np.maximum(total, 1)))


@F.pandas_udf(T.DoubleType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_blocks(_indel, a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / total length of the texts with their words in order."""
    ordered = lambda t: F.array_join(F.array_sort(F.filter(F.split(t, r"\s+"), lambda w: w != "")), " ")
    return _indel_ratio(ordered(a), ordered(b))
