"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence has probability p = sigmoid(bias + sum of its words' weights); a document is toxic
with the noisy-or 1 - prod(1 - p) over its sentences. Only documents are labelled, so the
gradient of the document's loss decides which sentences explain the label, and the same
sentence scores locate the offending passages.

Defined cases: null or empty text has no sentence, hence score 0; without labels of both
classes every score is 0. Words are compared in lower case; a word counts once per sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import class_sample, learning_labels

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIX = 4
REMEMBERED = 500_000  # words whose weight a worker keeps at hand


def word_features(word: str) -> tuple[str, ...]:
    """The word itself and its stem-like prefix, so that unseen inflections still count."""
    return (word, word[:PREFIX] + "*") if len(word) > PREFIX else (word,)


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return w

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence with a word."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m.group().lower()))
            if words:
                z = self.bias + sum(map(self.word_weight, words))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(min(z, 40.0), -40.0)))))
        return out

    def score(self, text: str | None) -> float:
        """Noisy-or of the whole text's sentences."""
        logs, known, find, bias = 0.0, self.known, WORD.findall, self.bias
        for part in SENTENCE.findall((text or "").lower()):
            words = set(find(part))
            if words:
                try:
                    z = bias + sum([known[w] for w in words])
                except KeyError:
                    z = bias + sum(map(self.word_weight, words))
                logs += max(z, 0.0) + math.log1p(math.exp(-abs(z)))  # -log(1 - p)
        return -math.expm1(-logs)


def _bags(texts: list[str]) -> list[list[set[str]]]:
    found = [[{f for w in set(WORD.findall(s)) for f in word_features(w)} for s in SENTENCE.findall(t.lower())] for t in texts]
    return [[s for s in bag if s] for bag in found]


def _calibrated(model: ToxicityModel, texts: list[str], y: np.ndarray) -> ToxicityModel:
    """Moves the bias so that 0.5 lies midway between the labels of documents not used for the weights."""
    logs = np.array([-math.log1p(-min(model.score(t), 1 - 1e-15)) for t in texts])
    z = np.log(np.expm1(np.maximum(logs, 1e-15)))  # log odds of the document
    if len(set(y.tolist())) < 2:
        return model
    cuts = np.unique(np.concatenate([z - 1e-6, z + 1e-6]))
    wrong = np.array([(z[y == 0] >= c).mean() * 3 + (z[y == 1] < c).mean() for c in cuts])
    best = cuts[wrong <= wrong.min() + 1e-12]
    shift = -float(best.min() + best.max()) / 2
    return ToxicityModel(model.bias + min(max(shift, -4.0), 2.0), model.weights)


def loss_gradient(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, columns: np.ndarray, owner: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the documents' weighted log loss by weights and bias.

    ``rows, columns``: sentence and feature of every feature that a sentence has; ``owner``: the
    document of a sentence. With ``logs`` = -log(1 - P) of a document, its loss is ``logs`` for
    label 0 and -log(1 - exp(-logs)) for label 1.
    """
    z = np.clip(bias[0] + np.bincount(rows, w[columns], minlength=len(owner)), -30, 30)
    p = 1 / (1 + np.exp(-z))
    logs = np.bincount(owner, np.logaddexp(0, z), minlength=len(y))
    pull = np.where(y == 1, -1 / np.expm1(np.clip(logs, 1e-12, 30)), 1.0) * balance
    g = pull[owner] * p
    return np.bincount(columns, g[rows], minlength=len(w)), np.array([g.sum()])


def fit(texts: list[str], y: np.ndarray, min_documents: int = 3, epochs: int = 150, rate: float = 0.1, sparse: float = 0.02) -> ToxicityModel | None:
    """Adam with soft thresholding on the documents' log loss; None unless both labels occur.

    Features of fewer than ``min_documents`` of the sample stay at zero, and each step takes
    ``sparse`` off every weight, so that only features which keep helping survive. Weights
    start at the smoothed log odds of documents with the feature, where these speak for
    toxicity. Every fourth document is kept apart to set the bias.
    """
    if len(set(y.tolist())) < 2:
        return None
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[3::4]] = True
    kept = [t for t, a in zip(texts, apart, strict=True) if not a]
    rest, rest_y = [t for t, a in zip(texts, apart, strict=True) if a], y[apart]
    y = y[~apart]
    bags = _bags(kept)
    seen = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        seen[int(label)].update(set().union(*bag) if bag else ())
    total = np.bincount(y.astype(int), minlength=2)
    vocabulary = {f: i for i, f in enumerate(sorted(f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= min_documents))}
    names = list(vocabulary)
    odds = np.array([math.log((seen[1][f] + 0.1) / (total[1] + 0.2)) - math.log((seen[0][f] + 0.1) / (total[0] + 0.2)) for f in names])
    rows, columns, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            ids = [vocabulary[f] for f in s if f in vocabulary]
            rows += [len(owner)] * len(ids)
            columns += ids
            owner.append(d)
    rows, columns, owner = np.array(rows, int), np.array(columns, int), np.array(owner, int)
    w = np.where(odds > 2, odds, 0.0)
    bias = np.array([-9.0])
    balance = np.where(y == 1, 0.5 / total[1], 0.5 / total[0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, bias)]
    for t in range(1, epochs + 1):
        grads = loss_gradient(w, bias, rows, columns, owner, y, balance)
        for param, grad, m in zip((w, bias), grads, moments, strict=True):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.001 * (grad * grad - m[1])
            param -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-5)
        w = np.sign(w) * np.maximum(np.abs(w) - sparse, 0)
        bias[0] = min(bias[0], -8.0)  # an ordinary sentence stays far below a thousandth, also in long texts
    model = ToxicityModel(float(bias[0]), {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 0.05})
    return _calibrated(model, rest, rest_y)


def shortened(text: str, chars: int) -> str:
    """A text of at most about ``chars`` characters: evenly placed sentences (or words, of one long sentence) of a longer one."""
    if len(text) <= chars:
        return text
    parts = [s for s in SENTENCE.findall(text) if s.strip()]
    if max(map(len, parts), default=0) > chars // 4:
        parts = [" ".join(words[i : i + 20]) for words in (text.split(),) for i in range(0, len(words), 20)]
    share = chars / sum(map(len, parts))
    # places by the golden ratio are even, and miss nothing that comes at regular distances
    return ". ".join(p[:chars] for i, p in enumerate(parts) if i * 0.6180339887498949 % 1 < share)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, chars: int = 12_000) -> ToxicityModel | None:
    """Fit on about ``per_class`` labelled documents of each label outside the held-out fold.

    To bound the driver's memory, a sampled document longer than ``chars`` gives evenly placed
    sentences of its whole text (every text is scored whole). The ids are the broadcast side;
    of rows repeating an id the smallest text counts.
    """
    chosen, counts = class_sample(learning_labels(labels, "toxic"), "doc_id", "y", per_class)
    if len(counts) < 2:
        return None
    cut = F.pandas_udf(lambda texts: pd.Series([shortened(t, chars) for t in texts], dtype=object), "string")
    sampled = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = sampled.select("doc_id", "y", cut("text").alias("text")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fit([r.text for r in rows], np.array([r.y for r in rows])) if rows else None


def toxicity_score(model: ToxicityModel | None, text: Column) -> Column:
    """Noisy-or score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) if model else 0.0 for t in texts], dtype="float64")

    return score(text)


def offending_sentences(model: ToxicityModel | None, docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of every sentence that scores ``at_least``; code points, end exclusive."""

    @F.pandas_udf("array<struct<start:int,end:int,score:double>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[s for s in model.sentences(t) if s[2] >= at_least] if model else [] for t in texts])

    return docs.select("doc_id", F.explode(find("text")).alias("s")).select("doc_id", "s.start", "s.end", "s.score")
