"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile.

Every labelled pair (good document, bad document) is one comparison that the good one wins.
Under the Bradley-Terry model its log odds are the difference of the two scores; with a score
linear in the features, the loss is the logistic loss of feature differences.

Defined cases: a null or empty text has the features of no characters and is scored like any
other text; without labels of both classes every score is 0.5 (nothing is rejected).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import class_sample, learning_labels

CUT = 0.3
WINDOW = 64  # words
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: shares of characters, repetition overall and in its worst window."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    m = max(len(words), 1)
    worst_distinct, worst_marks = 1.0, 0.0
    sums = [0.0, 0.0]
    parts = range(0, len(words), WINDOW)
    for i in parts:
        part = words[i : i + WINDOW]
        k = len(part)
        distinct = len(set(part)) / k if k > 8 else 1.0
        marks = len(_MARKS.findall(b" ".join(part))) / k
        worst_distinct, worst_marks = min(worst_distinct, distinct), max(worst_marks, marks)
        sums[0] += distinct
        sums[1] += marks
    k = max(len(parts), 1)
    lines = raw.split(b"\n")
    shares = [
        count[65:91].sum() / n,
        count[97:123].sum() / n,
        count[48:58].sum() / n,
        count[10] / n,
        count[128:].sum() / n,
        count[_PUNCT].sum() / n,
        sum(map(eq, words, words[1:])) / m,
        1 - sums[0] / k if words else 0.0,
        1 - worst_distinct,
        sums[1] / k,
        worst_marks,
        1 - len(set(lines)) / len(lines),
        *(count[_PUNCT] / n),
    ]
    return np.concatenate([[np.log1p(len(raw)), np.log1p(n / m)], np.sqrt(np.asarray(shares))])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and CUT exactly at the quantile threshold."""
        z = np.log(CUT / (1 - CUT)) + self.slope * (self.raw(x) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(winners: np.ndarray, losers: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of the logistic loss on feature differences, by Newton steps (ridge keeps it bounded)."""
    diff = winners - losers
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ p / len(diff) - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, share_low: float, pairs: int = 40_000, seed: int = 7) -> QualityModel | None:
    """Model from labelled features; None unless both labels occur.

    The threshold is the ``share_low`` quantile of the scores, rows weighted so that the
    two labels have their shares of the whole table.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    w = bradley_terry(z[rng.choice(good, pairs)], z[rng.choice(bad, pairs)])
    s = z @ w
    weight = np.where(y == 1, (1 - share_low) / len(good), share_low / len(bad))
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(np.cumsum(weight[order]), share_low - 1e-9)
    low, high = s[order[min(at, len(s) - 1)]], s[order[min(at + 1, len(s) - 1)]]
    threshold = (low + high) / 2
    slopes = np.geomspace(0.05, 5, 25)
    side = np.where(y == 1, 1.0, -1.0)
    base = np.log(CUT / (1 - CUT))
    loss = [np.sum(weight * np.logaddexp(0, -side * (base + a * (s - threshold)))) for a in slopes]
    return QualityModel(mean, scale, w, float(threshold), float(slopes[int(np.argmin(loss))]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> QualityModel | None:
    """Fit on about ``per_class`` labelled documents of each label outside the held-out fold.

    Only features of these at most some 6000 rows come to the driver; their ids are the
    broadcast side, so no text is shuffled. Of rows repeating an id the smallest features count.
    """
    chosen, counts = class_sample(learning_labels(labels, "quality"), "doc_id", "y", per_class)
    if len(counts) < 2:
        return None
    shape = F.pandas_udf(lambda t: pd.Series([features(x) for x in t]), "array<double>")
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "y", shape("text").alias("x"))
        .groupBy("doc_id", "y")
        .agg(F.min("x").alias("x"))
        .orderBy("doc_id")
        .collect()
    )
    if not rows:
        return None
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    return fit(x, y, counts.get(0, 0) / sum(counts.values()))


def quality_score(model: QualityModel | None, text: Column) -> Column:
    """Score column of a text column; 0.5 without a model."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series([0.5] * len(texts), dtype="float64")
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    return score(text)
