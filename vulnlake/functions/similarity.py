"""String similarity."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions.folds import bound

_BAGS = 128
_GRAM_BAGS = 512
_PAIRS = 512  # pairs whose characters are counted at a time


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``2 * matches / total length`` of two strings (stdlib matcher)."""
    return pd.Series(
        [
            None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


def ratio_at_least(a: str, b: str, threshold: float) -> float | None:
    """Matcher ratio, or None below ``threshold``; its cheap upper bounds are tried first."""
    matcher = SequenceMatcher(None, a, b)
    if matcher.real_quick_ratio() < threshold or matcher.quick_ratio() < threshold:
        return None
    ratio = matcher.ratio()
    return ratio if ratio >= threshold else None


def bag_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bound of the matcher ratio of each pair: the characters they share in any order.

    Characters are counted in ``_BAGS`` bags; those that fall together only raise the bound.
    """

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % _BAGS
        at = np.repeat(np.arange(len(texts)) * _BAGS, lengths) + codes
        return np.bincount(at, minlength=_BAGS * len(texts)).reshape(-1, _BAGS), lengths

    (x, m), (y, n) = counted(a), counted(b)
    return np.where(m + n > 0, 2.0 * np.minimum(x, y).sum(axis=1) / np.maximum(m + n, 1), 1.0)


def sequence_ratio_above(threshold: float) -> Callable[[Column, Column], Column]:
    """:func:`sequence_ratio` for callers that need only values of ``threshold`` or more."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        for start in range(0, len(a), _PAIRS):
            xs, ys = a[start : start + _PAIRS].tolist(), b[start : start + _PAIRS].tolist()
            for i in np.flatnonzero(bag_bounds(xs, ys) >= threshold):
                ratio = ratio_at_least(xs[i], ys[i], threshold)
                out[start + i] = np.nan if ratio is None else ratio
        return pd.Series(out)

    return F.pandas_udf(score, T.DoubleType())


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of :func:`sequence_ratio` from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(
        F.try_divide(2.0 * F.least(F.length(a), F.length(b)), total)
    )


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit-distance similarity, all in the JVM: ``1 - distance / longer length``."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(
        1.0 - F.try_divide(F.levenshtein(a, b).cast("double"), longest)
    )


@F.pandas_udf(T.DoubleType())
def _gram_bounds(a: pd.Series, b: pd.Series) -> pd.Series:
    """Upper bound of :func:`levenshtein_ratio`: an edit changes at most three of the three-character pieces.

    Pieces are counted in ``_GRAM_BAGS`` bags; those that fall together only raise the bound.
    """

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        grams = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % _GRAM_BAGS
        whole = row[:-2] == row[2:]
        return np.bincount((row[:-2] * _GRAM_BAGS + grams)[whole], minlength=_GRAM_BAGS * len(texts)).reshape(-1, _GRAM_BAGS), lengths

    out = np.ones(len(a))
    for start in range(0, len(a), _PAIRS):
        (x, m), (y, n) = counted(a[start : start + _PAIRS].tolist()), counted(b[start : start + _PAIRS].tolist())
        longest = np.maximum(m, n)
        changed = np.maximum(longest - 2 - np.minimum(x, y).sum(axis=1), 0)
        out[start : start + _PAIRS] = 1.0 - np.ceil(changed / 3) / np.maximum(longest, 1)
    return pd.Series(out)


def levenshtein_ratio_above(threshold: float, digits: int = 6) -> Callable[[Column, Column], Column]:
    """:func:`levenshtein_ratio`, rounded, for callers that need only values of ``threshold`` or more.

    The distance is worked out once, where the shared pieces allow such a value, and followed only
    as far as it allows; beyond that it is null.
    """
    slack = 10.0**-digits

    def ratio(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(b))
        most = F.floor((1.0 - threshold + slack) * longest).cast("int") + 1
        reached = lambda d: F.when(d >= 0, F.round(1.0 - F.try_divide(d.cast("double"), longest), digits))
        within = F.when(_gram_bounds(a, b) >= threshold - slack, bound(F.call_function("levenshtein", a, b, most), reached))
        return F.when(longest == 0, 1.0).otherwise(within)

    return ratio


def levenshtein_bound(a: Column, b: Column, digits: int = 6) -> Column:
    """Upper bound of the rounded :func:`levenshtein_ratio` from the lengths alone."""
    shorter, longest = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.round(1.0 - F.try_divide((longest - shorter).cast("double"), longest), digits))
