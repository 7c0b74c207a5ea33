"""Periodic runs of a text's words: difference-cover LCE and harmonic-grid enumeration.

A run is a stretch of consecutive words with smallest period q and length of at least
max(24, 3 * q), extended as far as the period holds. Every run of period q covers two neighbours
of the grid 0, q, 2q, ...; so for each q the grid's neighbours are extended to both sides by
longest-common-extension queries, n log n of them for n words.

* An LCE query (i, j) compares few words to reach the next pair of positions whose residues modulo
  31 both lie in a difference cover (six residues, so that every distance has such a pair).
  Only suffixes at cover positions are sorted: blocks of 31 words get names, and prefix doubling
  over the names orders the samples. Their common prefixes follow from a sparse table of minima
  over neighbours in that order; what is left after the last equal block is compared directly.
* The few words come first: a neighbour pair that has not 16 equal words in a row around it lies
  in no run (max(24, 3q) - q >= 16), and samples are sorted only for texts with pairs left.
* Texts of an Arrow batch are laid end to end with separators that equal nothing, so that all of
  this is array work over many texts at once; a batch is cut by its bytes.

The work is a map over documents: no shuffle, and a text's memory is a small multiple of its words.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text; a text
without an id is not altered by ``with_period``; repeated rows are worked out each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.pieces import slices

LEAST, TIMES = 24, 3  # shortest run in words, and in periods
SURE = LEAST - LEAST // TIMES  # equal words q apart that every run has
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # fixed values: every difference modulo 31 once
PAIRS = 1 << 20  # grid pairs held at once

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: for a distance modulo PERIOD: a residue of the cover whose partner at that distance is in the cover too
_MEET = np.array([next(a for a in COVER if (a + d) % PERIOD in COVER) for d in range(PERIOD)])


def with_period(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Index of the original word that stands at each place: a tenth of the ids get a periodic end."""
    n = len(words)
    at = np.arange(n)
    if doc_id is None or n == 0:
        return at
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def matched(x: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray | int, step: int = 1) -> np.ndarray:
    """Number of equal words from i and j on (backwards for step -1), at most ``limit``."""
    limit = np.broadcast_to(limit, i.shape)
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(limit > 0)
    t = 0
    while len(live):
        live = live[x[i[live] + step * t] == x[j[live] + step * t]]
        t += 1
        out[live] = t
        live = live[limit[live] > t]
    return out


class Samples:
    """Sorted suffixes at cover positions of x, whose words are 0 or more and separators negative and unique.

    x ends with at least 2 * PERIOD separators.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x) - 2 * PERIOD
        parts = [np.arange(r, n, PERIOD) for r in COVER]
        at = np.concatenate(parts)
        self.number = np.full(len(x), -1, np.int64)
        self.number[at] = np.arange(len(at))
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, PERIOD)[at])
        names = np.unique(blocks.view(np.dtype((np.void, blocks.dtype.itemsize * PERIOD))).ravel(), return_inverse=True)[1].ravel()
        left = np.concatenate([np.arange(len(p), 0, -1) for p in parts]) if len(at) else at  # blocks up to the end of the residue
        levels, size = [names.astype(np.int64)], 1
        while len(at) and size < left.max() and levels[-1].max() + 1 < len(at):
            follow = np.where(left > size, levels[-1][np.minimum(np.arange(len(at)) + size, len(at) - 1)] + 1, 0)
            levels.append(np.unique(levels[-1] * (len(at) + 1) + follow, return_inverse=True)[1].ravel())
            size *= 2
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            # a residue's last block holds the last separator and equals no other, so equal ranks never reach past one
            same = levels[k][a] == levels[k][b]
            shared[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.table = [shared]
        while 2 << len(self.table) - 1 <= len(shared):
            low, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal blocks from two different sampled positions on: a range minimum."""
        a, b = self.rank[self.number[i]], self.rank[self.number[j]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.int64(np.frexp((b - a).astype(np.float64))[1]) - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.table[k][a[of]], self.table[k][b[of] - (1 << k)])
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on, for i < j."""
        shift = (_MEET[(j - i) % PERIOD] - i) % PERIOD
        out = matched(self.x, i, j, shift)
        deep = np.flatnonzero(out == shift)
        deep = deep[self.x[j[deep] + shift[deep]] >= 0]
        a, b = i[deep] + shift[deep], j[deep] + shift[deep]
        run = PERIOD * self._blocks(a, b)
        out[deep] += run + matched(self.x, a + run, b + run, PERIOD)
        return out


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts (word codes) end to end between unique separators, and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts)]
    x = np.full(int(sizes.sum()) + len(texts) + 1 + 2 * PERIOD, -1, np.int64)
    for t, at in zip(texts, begin.tolist(), strict=True):
        x[at : at + len(t)] = t
    gaps = np.flatnonzero(x < 0)
    x[gaps] = -1 - np.arange(len(gaps))
    return x, begin


def _grids(sizes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all neighbours of all grids, in blocks of about PAIRS."""
    text = np.repeat(np.arange(len(sizes)), sizes // TIMES)
    firsts = np.concatenate([[0], np.cumsum(sizes // TIMES)])[:-1]
    period = np.arange(len(text)) - firsts[text] + 1
    count = (sizes[text] - 1) // period  # neighbours of one grid
    cut = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), PAIRS)) if len(count) else []
    for low, high in zip(cut, [*cut[1:], len(count)], strict=True):
        of = np.repeat(np.arange(low, high), count[low:high])
        k = np.arange(len(of)) - np.repeat(np.cumsum(count[low:high]) - count[low:high], count[low:high])
        yield begin[text[of]] + k * period[of], period[of]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (word codes, 0 or more): its runs as rows start, length, period, by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    long = [k for k, t in enumerate(texts) if len(t) >= LEAST]
    if not long:
        return out
    x, begin = joined([texts[k] for k in long])
    found = []
    for i, q in _grids(np.array([len(texts[k]) for k in long]), begin):
        near = np.flatnonzero(x[i] == x[i + q])
        i, q = i[near], q[near]
        around = matched(x, i, i + q, SURE)
        short = np.flatnonzero(around < SURE)
        around[short] += matched(x, i[short] - 1, i[short] + q[short] - 1, SURE - around[short], -1)
        found.append(np.stack([i, q])[:, around >= SURE])
    i, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not len(i):
        return out
    # samples of the texts that have pairs left, from the front and from the back
    of = np.searchsorted(begin, i, side="right") - 1
    deep = np.unique(of)
    x, at = joined([texts[long[k]] for k in deep])
    own = np.searchsorted(deep, of)
    i = i - begin[of] + at[own]
    ahead = Samples(x)
    turned = np.concatenate([x[: len(x) - 2 * PERIOD][::-1], x[len(x) - 2 * PERIOD :]])
    behind = Samples(turned)
    top = len(x) - 2 * PERIOD - 1
    before = behind.lce(top - (i + q - 1), top - (i - 1))
    length = q + before + ahead.lce(i, i + q)
    rows = np.stack([own, i - before - at[own], length, q], axis=1)[length >= np.maximum(LEAST, TIMES * q)]
    # one stretch has all multiples of its period that fit three times; the smallest is the run's
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for k, part in zip(deep, np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, len(deep)))), strict=True):
        out[long[k]] = part
    return out


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties to the smaller start, then period."""
    if not len(runs):
        return None
    share = runs[:, 1] / runs[:, 2]
    likely = runs[share >= share.max() * (1 - 1e-9)].tolist()
    return tuple(min(likely, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words that some run contains after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("best", _RUNS.value_type), ("collapsed", pa.string())]


def periodic_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """doc_id, n_words, all runs, the strongest one, and the text without repeats, of every whole text.

    ``altered`` first gives a tenth of the texts a periodic end (see ``with_period``).
    """
    shape = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part["doc_id"].to_pylist()
                words = [(t or "").encode("utf-8", "replace").split() for t in part["text"].to_pylist()]
                flat = np.empty(sum(map(len, words)), object)
                flat[:] = [w for row in words for w in row]
                ends = np.cumsum([len(row) for row in words])
                codes = np.split(pd.factorize(flat)[0].astype(np.int64), ends[:-1])
                places = [with_period(row, i if altered else None) for row, i in zip(codes, ids, strict=True)]
                texts = [row[at] for row, at in zip(codes, places, strict=True)]
                runs = runs_of(texts)
                best = [strongest(r) for r in runs]
                kept = [at[~repeats(len(at), r)] if len(r) else at for at, r in zip(places, runs, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n_words": [len(row) for row in words],
                        "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()] for rows in runs],
                        "best": [None if b is None else dict(zip(("start", "length", "period"), b, strict=True)) for b in best],
                        "collapsed": [b" ".join([row[k] for k in at.tolist()]).decode("utf-8", "replace") for row, at in zip(words, kept, strict=True)],
                    },
                    schema=shape,
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    run_type = "struct<start:long,length:long,period:long>"
    return columns.mapInArrow(run, f"doc_id long, n_words long, runs array<{run_type}>, best {run_type}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    written = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    exponent = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        exponent.alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
