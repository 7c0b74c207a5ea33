"""Periodic runs against a plain enumeration, and LCE queries against word-by-word comparison."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helpers import DOCS, odd_rows
from vulnlake.llm import runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by the definition: every period, every stretch of equal words one period apart."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - i + q >= max(24, 3 * q):
                found.setdefault((i, end - i + q), q)
            i = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    written = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    return (doc_id, len(found), *best, milli, sha(written), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_texts(rng: random.Random, count: int) -> list[list[int]]:
    out = []
    for _ in range(count):
        words = []
        for _ in range(rng.randint(0, 5)):
            unit = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
            words += (unit * 12)[: rng.randint(1, 90)] if rng.random() < 0.7 else [rng.randint(0, 500) for _ in range(rng.randint(1, 80))]
        out.append(words)
    return out


def test_runs_equal_the_definition():
    texts = periodic_texts(random.Random(3), 400) + [[], [1] * 23, [1] * 24, [1, 2] * 500, list(range(40)) * 3, list(range(40)) * 2]
    got = runs.runs_of([np.array(t, np.int64) for t in texts])
    for text, rows in zip(texts, got, strict=True):
        assert [tuple(r) for r in rows.tolist()] == plain_runs(text)
    assert sum(map(len, got)) > 300


def test_extensions_equal_direct_comparison():
    rng = np.random.default_rng(2)
    for text in (rng.integers(0, 2, 700), np.tile(rng.integers(0, 3, 50), 14), np.zeros(400, np.int64), rng.integers(0, 90, 20)):
        x, begin = runs.joined([text, text[:100]])
        samples = runs.Samples(x)
        i = rng.integers(begin[0], begin[0] + len(text) - 1, 500)
        j = np.minimum(i + rng.integers(1, len(text), 500), begin[0] + len(text) - 1)
        i, j = i[i < j], j[i < j]
        want = [next(t for t in range(len(x)) if x[a + t] != x[b + t]) for a, b in zip(i, j, strict=True)]
        assert samples.lce(i, j).tolist() == want


def test_the_cover_meets_every_distance():
    pairs = {(b - a) % runs.PERIOD for a in runs.COVER for b in runs.COVER}
    assert pairs == set(range(runs.PERIOD)) and len(runs.COVER) ** 2 - len(runs.COVER) + 1 == runs.PERIOD


def test_grids_are_whole_over_many_blocks(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    sizes = np.array([3, 40, 25, 2])
    got = [(int(p), int(q)) for i, q in runs._grids(sizes, np.array([1, 10, 100, 200])) for p, q in zip(i, q, strict=True)]
    want = [(b + k * q, q) for n, b in zip(sizes, (1, 10, 100, 200), strict=True) for q in range(1, n // 3 + 1) for k in range((n - 1) // q)]
    assert sorted(got) == sorted(want)


def test_digests_of_odd_and_periodic_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{c}" for c in t)) for i, t in enumerate(periodic_texts(rng, 150))] + [(3, "again " * 40), (3, "again " * 40)]
    table = [(i, t, None, None, None, None, None) for i, t in rows] + [r for r in odd_rows() if not r[1] or len(r[1]) < 5000]
    got = runs.digests(runs.periodic_runs(spark.createDataFrame(table, DOCS), altered=True)).collect()
    want = [plain_digests(r[0], r[1]) for r in table]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert runs.digests(runs.periodic_runs(spark.createDataFrame([], DOCS))).count() == 0


def test_a_long_text_in_bounded_time():
    unit = np.arange(700)
    text = np.concatenate([np.arange(1000, 101_000), np.tile(unit, 100), np.full(60_000, 999_999)])
    (rows,) = runs.runs_of([text])
    assert [tuple(r) for r in rows.tolist()] == [(100_000, 70_000, 700), (170_000, 60_000, 1)]


@pytest.mark.parametrize("rows,want", [([(0, 30, 7), (5, 60, 14), (9, 90, 30)], (0, 30, 7)), ([(4, 24, 8), (4, 48, 16), (2, 27, 9)], (2, 27, 9)), ([], None)])
def test_the_strongest_run_is_compared_exactly(rows, want):
    assert runs.strongest(np.array(rows, np.int64).reshape(-1, 3)) == want
