"""Centroid clustering over cells against a plain restatement."""

import hashlib

import numpy as np
import pytest

from vulnlake.llm import va_file

VECTORS = "vec_id long, embedding array<float>, key long, cluster string, row int"
FIRST = "sha2(concat('1:', cast(key AS string)), 256)"


def plain(rows, k=16, rounds=3):
    kept = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in order[:k]]
    x = [v for _, v in kept]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for v in x]
        for n in range(len(centres)):
            own = [v for v, c in zip(x, at, strict=True) if c == n]
            if own:
                centres[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    best = [nearest(v) for v in x]
    total = sum(d for d, _ in best)
    each = {n: sum(d for d, m in best if m == n) for n in range(len(centres))}
    return sorted((str(i), n, d, each[n], total, tuple(centres[n])) for (i, _), (d, n) in zip(kept, best, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)


def odd(x):
    return [(None, x[0]), (5, x[1]), (5, x[1]), (900, None), (901, []), (902, [0.5] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] * 64), (906, [0.0] * 64)]


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


@pytest.mark.parametrize("fetch", [va_file.FETCH, 0])
def test_clusters_equal_a_plain_restatement(spark, monkeypatch, fetch):
    monkeypatch.setattr(va_file, "FETCH", fetch)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64))
    x = np.concatenate([centres[rng.integers(0, 20, 300)] + 0.3 * rng.normal(size=(300, 64)), np.repeat(centres[:1], 200, axis=0)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += odd([r[1] for r in rows])
    assert got(va_file.clusters(table(spark, rows), "vec_id", FIRST)) == plain(rows)


@pytest.mark.parametrize("count", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, count):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=64)]) for i in range(count)]
    assert got(va_file.clusters(table(spark, rows), "vec_id", FIRST)) == plain(rows)


def test_intervals_hold_the_distance():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (500, 7))
    edges = np.sort(rng.choice(np.arange(-49, 50), (7, va_file.CELLS - 1)), axis=1)
    low = np.concatenate([np.full((7, 1), -50), edges], axis=1)
    cells = va_file.Cells(low, np.concatenate([low[:, 1:] - 1, np.full((7, 1), 49)], axis=1))
    packed, centres = cells.of(x), rng.integers(-60, 60, (9, 7))
    least, most = va_file.intervals(cells, packed, centres)
    exact = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (least <= exact).all() and (exact <= most).all()
    assert va_file.possible(cells, packed, centres)[np.arange(500), exact.argmin(axis=1)].all()
