"""Byte-pair merging of many distinct words at once in numpy, and ragged-array helpers.

A batch's words are reduced to distinct ones first; these are merged together, all words one
step at a time, so the cost per word is a few array operations instead of a Python loop. A step
moves the whole word, so words of more than ``LONG`` symbols are merged one by one through a
heap over linked symbols instead.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.int32(2**31 - 1)
_SIZES = (4, 8, 12, 16, 24, 48)
LONG = 256


class PairTable:
    """(left, right) -> (rank, merged symbol) for arrays of pairs: open addressing, linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys, first = np.unique(keys, return_index=True)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            at = slot[left_over]
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)  # one key per free slot
            put = left_over[free[one]]
            self.keys[slot[put]] = keys[put]
            self.rank[slot[put]] = rank[first[put]]
            self.merged[slot[put]] = merged[first[put]]
            left_over = left_over[self.keys[slot[left_over]] != keys[left_over]]
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; where a pair is unknown, an empty slot (its rank is NONE)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            open_ = open_[(got != keys[open_]) & (got != -1)]
        return slot

    def single(self) -> dict[int, tuple[int, int]]:
        """The same table for one pair at a time: left << 32 | right -> (rank, merged symbol)."""
        if not hasattr(self, "_single"):
            used = self.keys != -1
            self._single = dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.merged[used].tolist(), strict=True), strict=True))
        return self._single


def merge_words(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges every word to the end: (symbols, lengths) of all words in their order.

    Each step joins the pair of the lowest rank, the leftmost of equals, in every word.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    out_lengths = lengths.astype(np.int64).copy()
    rows_done, data_done = [], []
    low = 0
    for size in (*_SIZES, min(int(lengths.max(initial=0)) + 1, LONG)):
        rows = np.flatnonzero((lengths > low) & (lengths <= size))
        low = max(low, size)
        block = max(64, 4_000_000 // size)
        for i in range(0, len(rows), block):
            part = rows[i : i + block]
            s = _merge_block(table, symbols, starts[part], lengths[part], size)
            kept = s >= 0
            out_lengths[part] = kept.sum(axis=1)
            rows_done.append(np.repeat(part, out_lengths[part]))
            data_done.append(s[kept])
    for row in np.flatnonzero(lengths > LONG).tolist():
        s = _merge_long(table, symbols[starts[row] : starts[row] + lengths[row]])
        out_lengths[row] = len(s)
        rows_done.append(np.full(len(s), row))
        data_done.append(s)
    if not rows_done:
        return np.zeros(0, np.int32), out_lengths
    rows, data = np.concatenate(rows_done), np.concatenate(data_done)
    return data[np.argsort(rows, kind="stable")], out_lengths


def _merge_block(table: PairTable, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    column = np.arange(size)
    inside = column < lengths[:, None]
    s = np.where(inside, symbols[np.minimum(starts[:, None] + column, len(symbols) - 1)], -1).astype(np.int32)
    result = s.copy()
    live = np.flatnonzero(lengths > 1)
    s = s[live]
    rank = np.full((len(live), size), NONE, np.int32)
    if size > 1 and len(live):
        both = (s[:, :-1] >= 0) & (s[:, 1:] >= 0)
        rank[:, :-1][both] = table.rank[table.find(s[:, :-1][both], s[:, 1:][both])]
    while len(live):
        at = rank.argmin(axis=1)
        row = np.arange(len(live))
        more = rank[row, at] != NONE
        if not more.all():
            result[live[~more]] = s[~more]
            live, s, rank, at = live[more], s[more], rank[more], at[more]
            row = np.arange(len(live))
            if not len(live):
                break
        s[row, at] = table.merged[table.find(s[row, at], s[row, at + 1])]
        tail = column[:-1] > at[:, None]
        s[:, :-1] = np.where(tail, s[:, 1:], s[:, :-1])
        s[:, -1] = -1
        # ranks belong to the left symbol of a pair: those right of the merged pair move along
        rank[:, :-1] = np.where(tail, rank[:, 1:], rank[:, :-1])
        rank[:, -1] = NONE
        for shift in (0, -1):
            a = at + shift
            b = np.minimum(a + 1, size - 1)
            ok = np.flatnonzero((a >= 0) & (a + 1 < size))
            ok = ok[s[ok, b[ok]] >= 0]
            fresh = np.full(len(at), NONE, np.int32)
            fresh[ok] = table.rank[table.find(s[ok, a[ok]], s[ok, b[ok]])]
            put = np.flatnonzero(a >= 0)
            rank[put, a[put]] = fresh[put]
    return result


def _merge_long(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """One word of any length: a heap of (rank, position, pair); entries whose pair is gone are skipped."""
    rank = table.rank[table.find(symbols[:-1], symbols[1:])]
    first = np.flatnonzero(rank != NONE)
    pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:].astype(np.int64)
    heap = list(zip(rank[first].tolist(), first.tolist(), pairs[first].tolist(), strict=True))
    heapify(heap)
    known, s, n = table.single(), symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if j >= n or s[i] << 32 | s[j] != pair:  # a symbol merged away is -1
            continue
        s[i], s[j], after[i] = known[pair][1], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                pair = s[a] << 32 | s[b]
                if pair in known:
                    heappush(heap, (known[pair][0], a, pair))
    out = np.array(s, np.int32)
    return out[out >= 0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, … (lengths[i] of them) for all i, concatenated."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Ragged:
    """Rows of different lengths in one array, e.g. the ids of each distinct word."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        self.data, self.lengths = data, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, rows: np.ndarray) -> Ragged:
        n = self.lengths[rows]
        return Ragged(self.data[spread(self.starts[rows], n)], n)

    def merged_by(self, counts: np.ndarray) -> Ragged:
        """Joins each run of ``counts[i]`` rows to one."""
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(self.lengths)])
        return Ragged(self.data, total[ends] - total[ends - counts])


def joined(rows: list[np.ndarray], parts: list[Ragged]) -> Ragged:
    """One ragged array whose row ``rows[k][i]`` is row i of ``parts[k]``."""
    total = sum(map(len, rows))
    lengths = np.zeros(total, np.int64)
    for at, part in zip(rows, parts, strict=True):
        lengths[at] = part.lengths
    out = np.empty(int(lengths.sum()), np.int32)
    starts = np.cumsum(lengths) - lengths
    for at, part in zip(rows, parts, strict=True):
        out[spread(starts[at], part.lengths)] = part.data[spread(part.starts, part.lengths)]
    return Ragged(out, lengths)
