"""Similarities of short texts: indel ratio (200 LCS / (|a| + |b|)), its bounds, and the best window."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SQL = """case when length(a) + length(b) = 0 then 100D when length(a) = 0 or length(b) = 0 then 0D else 200D * element_at(
  aggregate(split(a, ''), array_repeat(0, length(b) + 1), (p, c) -> aggregate(sequence(1, length(b)), array(0),
    (q, j) -> concat(q, array(if(substring(b, j, 1) = c, p[j - 1] + 1, greatest(p[j], q[j - 1])))))), -1) / (length(a) + length(b)) end"""


def register_fz_ratio(spark: SparkSession) -> None:
    """fz_ratio(a, b) for SQL: built-in functions only, for short texts."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fz_ratio(a STRING, b STRING) RETURNS DOUBLE RETURN {_SQL}")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a row's cells at once in the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


#: Characters of a text that fit a row's number in ratios(), characters of the other text that it compares at most, and texts that it takes at once.
_BITS, _WIDTH, _TEXTS = 64, 256, 64


def ratios(texts: list[str], others: list[str], n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """ratio() of each text with its n[i] next ones of `other` (places in `others`), for many pairs at once: as in _lcs a row is the bits of a number, and an array holds those of all pairs. Longer texts are compared one by one."""
    chars = {c: k for k, c in enumerate(sorted(set("".join(texts))))}  # len(chars) stands for all that no text has
    sizes, lengths = np.array([len(x) for x in texts]), np.array([len(x) for x in others])
    written = np.full((len(others), min(_WIDTH, max(lengths, default=0))), len(chars), np.int32)
    for i, x in enumerate(others):
        if len(x) <= _WIDTH:
            written[i, : len(x)] = [chars.get(c, len(chars)) for c in x]
    ends, out = np.concatenate([[0], np.cumsum(n)]), np.empty(len(other))
    for start in range(0, len(texts), _TEXTS):
        some = texts[start : start + _TEXTS]
        places = np.zeros((len(some), len(chars) + 1), np.uint64)
        for i, x in enumerate(some):
            for at, c in enumerate(x[:_BITS]):
                places[i, chars[c]] |= np.uint64(1 << at)
        rows = slice(ends[start], ends[start + len(some)])
        a, b = np.repeat(np.arange(len(some)), n[start : start + len(some)]), other[rows]
        long_first = np.argsort(-lengths[b], kind="stable")
        a, b = a[long_first], b[long_first]
        size, length = sizes[start + a], lengths[b]
        full = np.array([(1 << min(len(x), _BITS)) - 1 for x in some], np.uint64)[a]
        row = full.copy()
        for at in range(min(_WIDTH, length[0] if len(length) else 0)):
            open_ = np.searchsorted(-length, -at)  # those with a character here
            now = row[:open_]
            hit = now & places[a[:open_], written[b[:open_], at]]
            row[:open_] = (now + hit | now - hit) & full[:open_]
        found = np.full(len(row), 100.0)
        np.divide(200.0 * (size - np.bitwise_count(row)), size + length, out=found, where=size + length > 0)
        for i in np.flatnonzero((size > _BITS) | (length > _WIDTH)):
            found[i] = ratio(some[a[i]], others[b[i]])
        out[rows][long_first] = found
    return out


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text to any window of the longer one that is at most as long."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def indel_ratio(a: Column, b: Column) -> Column:
    """For texts of any length; null if one is null."""
    return _pairwise(ratio)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _pairwise(_partial)(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity from 0 to 1, another score than the above."""
    return _pairwise(lambda x, y: SequenceMatcher(None, x, y).ratio())(a, b)


def can_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether the ratio can be `cutoff` or more, by an upper bound of the common subsequence: the characters that the texts share, each as often as in both. No pair that reaches it is lost."""
    n = F.length(a) + F.length(b)
    chars = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(chars, F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    by_size = 200 * F.least(F.length(a), F.length(b)) >= cutoff * n
    return F.when(by_size, 200 * shared >= cutoff * n).otherwise(False)
