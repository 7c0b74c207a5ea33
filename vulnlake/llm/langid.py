"""Language ID: a byte convolutional network over fixed-length windows of the whole text.

Bytes are embedded, convolved with filters of several widths (stride 2), max-pooled over the
window and classified by softmax. Training is plain numpy on labelled windows. For inference
embedding and filters are folded into tables over byte pairs, so a window costs three table
look-ups per pair instead of matrix products; the numbers are the same.

Defined cases: a null text or one without any letter is ``und`` with score 0; without labelled
text everything is ``und``. A text shorter than a window is padded with zero bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import class_sample, held_out

LENGTH = 128  # bytes of a window
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBED = 8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> np.ndarray:
    """(n, LENGTH) bytes that cover the whole text; the last window ends with the text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) <= LENGTH:
        return np.pad(raw, (0, LENGTH - len(raw)))[None]
    whole = len(raw) // LENGTH
    out = raw[: whole * LENGTH].reshape(whole, LENGTH)
    return out if whole * LENGTH == len(raw) else np.concatenate([out, raw[None, -LENGTH:]])


@dataclass
class ByteCnn:
    """Weights; ``filters[w]`` has shape (w * EMBED, FILTERS)."""

    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteCnn:
        pooled = FILTERS * len(WIDTHS)
        return cls(
            languages,
            rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(pooled, np.float32),
            rng.normal(0, 0.2, (pooled, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *(self.filters[w] for w in WIDTHS), self.bias, self.dense, self.offset]

    def tables(self) -> list[np.ndarray]:
        """Per lane (pair 0, 1, 2 of a filter) what each byte pair adds to the filters that reach that lane.

        Filters are ordered from wide to narrow, so lane k concerns a leading part of them.
        """
        code = np.arange(1 << 16, dtype=np.uint16).view(np.uint8).reshape(-1, 2)
        pair = self.embed[code].reshape(1 << 16, 2 * EMBED)
        out = []
        for lane in range(max(WIDTHS) // 2):
            reach = [w for w in sorted(WIDTHS, reverse=True) if w // 2 > lane]
            out.append(np.concatenate([pair @ self.filters[w][lane * 2 * EMBED : (lane + 1) * 2 * EMBED] for w in reach], axis=1))
        return out


def backward(net: ByteCnn, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss and the gradients, in the order of ``parameters``."""
    n = len(x)
    e = net.embed[x]
    pooled, where, columns = [], [], []
    for w in WIDTHS:
        starts = np.arange(0, LENGTH - w + 1, 2)
        cols = np.concatenate([e[:, starts + k] for k in range(w)], axis=2)
        conv = cols @ net.filters[w]
        top = conv.argmax(axis=1)
        pooled.append(np.take_along_axis(conv, top[:, None], axis=1)[:, 0])
        where.append(starts[top])
        columns.append((cols, top))
    pre = np.concatenate(pooled, axis=1) + net.bias
    act = np.maximum(pre, 0)
    logit = act @ net.dense + net.offset
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(p[np.arange(n), y] + 1e-12).mean())
    d = p
    d[np.arange(n), y] -= 1
    d /= n
    g_act = (d @ net.dense.T) * (pre > 0)
    g_embed = np.zeros_like(net.embed)
    g_filters = []
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):
        g = g_act[:, i * FILTERS : (i + 1) * FILTERS]
        cols, top = columns[i]
        picked = cols[rows, top]  # (n, FILTERS, w * EMBED)
        g_filters.append(np.einsum("nf,nfd->df", g, picked, optimize=True))
        back = g[:, :, None] * net.filters[w].T[None]
        for k in range(w):
            byte = x[rows, where[i] + k]
            np.add.at(g_embed, byte.ravel(), back[:, :, k * EMBED : (k + 1) * EMBED].reshape(-1, EMBED))
    return loss, [g_embed, *g_filters, g_act.sum(axis=0), act.T @ d, d.sum(axis=0)]


def fit(x: np.ndarray, names: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.01, steps: int = 400, seed: int = 11) -> ByteCnn:
    """Adam with a falling rate over shuffled windows, for ``epochs`` or at least ``steps`` batches."""
    languages = sorted(set(names))
    y = np.array([languages.index(v) for v in names])
    rng = np.random.default_rng(seed)
    net = ByteCnn.fresh(languages, rng)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    per_epoch = -(-len(x) // batch)
    epochs = max(epochs, -(-steps // per_epoch))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            part = order[i : i + batch]
            _, grads = backward(net, x[part], y[part])
            t += 1
            step = rate * 0.03 ** (t / (epochs * per_epoch)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (step * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """Tables of a network, made once per Python worker."""

    def __init__(self, net: ByteCnn, block: int = 256):
        self.net, self.block = net, block
        self.lanes = net.tables()
        order = sorted(WIDTHS, reverse=True)
        take = [slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS) for w in order]
        self.bias = np.concatenate([net.bias[s] for s in take])
        self.dense = np.concatenate([net.dense[s] for s in take])

    def logits(self, x: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(x).view(np.uint16)
        pooled = np.empty((len(x), self.dense.shape[0]), np.float32)
        pairs = codes.shape[1]
        deepest = len(self.lanes) - 1
        for i in range(0, len(x), self.block):
            c = codes[i : i + self.block].T  # position first: pooling runs over the outer axis
            out = self.lanes[0][c]
            for lane in range(1, deepest + 1):
                reach = self.lanes[lane].shape[1]
                out[: pairs - lane, :, :reach] += self.lanes[lane][c[lane:]]
            # a filter of k pairs is complete only where k pairs follow
            for lane in range(1, deepest + 1):
                out[pairs - lane, :, : self.lanes[lane].shape[1]] = -np.inf
            pooled[i : i + self.block] = out.max(axis=0)
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.net.offset

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share, from the mean window logits of each whole text."""
        lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not lettered:
            return names, scores
        parts = [windows(texts[i]) for i in lettered]
        sizes = np.array([len(p) for p in parts])
        z = self.logits(np.concatenate(parts))
        z -= np.logaddexp.reduce(z, axis=1, keepdims=True)
        mean = np.add.reduceat(z, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for row, i in enumerate(lettered):
            names[i], scores[i] = self.net.languages[best[row]], float(p[row, best[row]])
        return names, scores


def train(docs: DataFrame, per_language: int = 400, per_document: int = 10) -> ByteCnn | None:
    """Fit on at most ``per_document`` windows of about ``per_language`` documents of each language.

    Only rows outside the held-out fold with a language and a letter count. The number of
    languages is taken to be small; their windows (128 bytes each) come to the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    )
    chosen, _ = class_sample(rows, "doc_id", "lang", per_language)

    @F.pandas_udf("array<binary>")
    def some(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = windows(t)
            keep = np.unique(np.linspace(0, len(w) - 1, per_document).astype(int))
            out.append([w[i].tobytes() for i in keep])
        return pd.Series(out)

    found = chosen.select("doc_id", "lang", some("text").alias("w")).orderBy("doc_id", "lang").collect()
    x = [np.frombuffer(w, np.uint8) for r in found for w in r.w]
    return fit(np.array(x), [r.lang for r in found for _ in r.w]) if x else None


def language(net: ByteCnn | None, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if net is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        if not hasattr(net, "ready"):  # this worker's copy
            net.ready = Predictor(net)
        names, scores = [], []
        rows = texts.tolist()
        for i in range(0, len(rows), 200):
            a, b = net.ready.predict(rows[i : i + 200])
            names += a
            scores += b
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)
