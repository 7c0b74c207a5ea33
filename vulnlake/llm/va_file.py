"""Centroid clustering over a VA-file: vectors held as few-bit cells, full vectors read where needed.

Every dimension is cut into 16 cells at quantiles of all vectors, and a vector's approximation is
its cell number per dimension, four bits each. For one round, a table per centroid gives the
smallest and largest squared difference for each (dimension, cell); their sums over a vector's
cells are an interval of its distance to the centroid. A centroid whose interval begins above the
smallest interval end cannot be nearest; where one centroid is left, the vector is assigned
without being read.

* The first round reads every vector beside its cells (all sums have to be made once), and so
  does the last (all distances are returned); both compute distances only where intervals overlap.
* The rounds between read the cells alone. Full vectors are fetched by row number only where
  intervals overlap or the centroid changed; sums follow from what moved. Up to ``FETCH`` row
  numbers are broadcast (counted before), more are joined by shuffle.
* Sums are made per Arrow batch before they are shuffled; to the driver come the cell edges, and
  sums and counts per centroid, whose number is fixed.

All arithmetic is on integers: components are floor(scale * x), centroids the exact floor of
sum / count, ties go to the smaller number, empty centroids stay where they are.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
take no part; rows that repeat an id are clustered each; a vector without an id is assigned but
never a first centroid; with fewer vectors than centroids each one with an id starts one; without
any there is no result row. Scaled components beyond 2 ** 24 count as that, so that sums stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.session import stage

CELLS = 16
FETCH = 100_000  # fetched rows whose numbers and cells may be broadcast (about 20 MB)
MOST = 1 << 24


def scaled(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """key and vector (integers) of the rows that take part."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) == size)).where(whole)

    def integer(x):
        return F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")

    return rows.select(F.col(key).cast("long").alias("key"), F.transform(v, integer).alias("vector"))


@dataclass(frozen=True)
class Cells:
    """Lowest and highest value of each cell, (dimensions, CELLS)."""

    low: np.ndarray
    high: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers, packed two a byte (n, ceil(dimensions / 2))."""
        cells = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            cells[:, d] = np.searchsorted(self.low[d], x[:, d], side="right") - 1
        if x.shape[1] % 2:
            cells = np.pad(cells, ((0, 0), (0, 1)))
        return cells[:, ::2] << 4 | cells[:, 1::2]

    def opened(self, packed: np.ndarray) -> np.ndarray:
        return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, : len(self.low)]


def fit_cells(rows: DataFrame, size: int) -> Cells:
    """Cell edges at quantiles of all vectors; the outermost are the exact least and largest values."""
    shares = F.array(*[F.lit(c / CELLS) for c in range(1, CELLS)])
    each = [f(F.col("vector")[d]) for d in range(size) for f in (F.min, F.max, lambda c: F.percentile_approx(c, shares, 2000))]
    seen = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(each)]).first()
    low = np.empty((size, CELLS), np.int64)
    high = np.empty((size, CELLS), np.int64)
    for d in range(size):
        least, most, inner = seen[3 * d], seen[3 * d + 1], seen[3 * d + 2]
        edges = sorted({least, *(q for q in inner if q > least)})
        # values that repeat over several quantiles leave fewer cells; the rest stay empty above the last
        low[d] = edges + [most + 1] * (CELLS - len(edges))
        high[d] = np.append(low[d][1:] - 1, most)
    return Cells(low, high)


def intervals(cells: Cells, packed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance of each vector's box to each centroid (n, k)."""
    opened = cells.opened(packed)
    low = np.zeros((len(packed), len(centroids)), np.int64)
    high = np.zeros_like(low)
    for d in range(len(cells.low)):
        under, over = cells.low[d][:, None] - centroids[:, d], centroids[:, d] - cells.high[d][:, None]
        nearest = np.maximum(np.maximum(under, over), 0)
        farthest = np.maximum(np.abs(under), np.abs(over))
        low += (nearest * nearest)[opened[:, d]]
        high += (farthest * farthest)[opened[:, d]]
    return low, high


def possible(cells: Cells, packed: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whether a centroid can be the nearest one, by the intervals (n, k)."""
    low, high = intervals(cells, packed, centroids)
    return low <= high.min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid among the open ones and its exact squared distance."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k in range(len(centroids)):
        rows = np.flatnonzero(open_[:, k])
        away = x[rows] - centroids[k]
        distance = (away * away).sum(axis=1)
        closer = distance < best[rows]
        best[rows[closer]], at[rows[closer]] = distance[closer], k
    return at, best


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype)


def _packed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _moved(old: np.ndarray, new: np.ndarray, x: np.ndarray, k: int) -> list[list[int]]:
    """What a batch adds to each centroid's sums and count (old -1: none)."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    ones = np.column_stack([x, np.ones(len(x), np.int64)])
    np.add.at(out, new, ones)
    left = old >= 0
    np.subtract.at(out, old[left], ones[left])
    return out.tolist()


def _total(parts: DataFrame, k: int, size: int) -> np.ndarray:
    """Sum of the batches' parts: k x (size + 1) numbers."""
    rows = parts.select(F.posexplode("delta").alias("cluster", "row")).select("cluster", F.posexplode("row").alias("d", "value"))
    out = np.zeros((k, size + 1), object)
    for r in rows.groupBy("cluster", "d").agg(F.sum("value").alias("value")).collect():  # k * (size + 1) rows
        out[r["cluster"], r["d"]] = r["value"]
    return out


def _replaced(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    size = centroids.shape[1]
    return np.array([[s // row[size] for s in row[:size]] if row[size] else old for old, row in zip(centroids.tolist(), sums.tolist(), strict=True)], np.int64)


def cluster(vectors: DataFrame, key: str, first: str, vector: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector after ``rounds`` rounds, and the final centroids.

    The first centroids are the k vectors with the smallest ``first``, an SQL expression of the
    column ``key`` (equal ones: the smaller vector).
    """
    rows = stage(scaled(vectors, key, vector, size, scale), "vectors")
    starts = rows.where("key IS NOT NULL").select(F.expr(first).alias("first"), "vector").orderBy("first", "vector").limit(k).collect()
    if not starts:  # without centroids nothing can be assigned
        return rows.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, size), np.int64)
    centroids = np.array([r["vector"] for r in starts], np.int64)
    k, width = len(centroids), (size + 1) // 2
    cells = fit_cells(rows, size)

    def approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = cells.of(_matrix(batch["vector"], size, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in packed], pa.binary())], names=[*batch.schema.names, "cells"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "key", "vector")
    file = stage(numbered.mapInArrow(approximated, "row long, key long, vector array<int>, cells binary"), "va-file")

    def measured(centroids: np.ndarray):
        """Assigns rows that carry cells and vector, with their exact distance."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                at, distance = nearest(_matrix(batch["vector"], size, np.int64), centroids, possible(cells, _packed(batch["cells"], width), centroids))
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(at, pa.int32()), pa.array(distance, pa.int64())], names=["key", "cluster", "distance"])

        return run

    def bounded(centroids: np.ndarray):
        """Reads cells only: how many centroids are still possible, the first of them, and all as bits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = _packed(batch["cells"], width)
                open_ = possible(cells, packed, centroids) if len(packed) else np.zeros((0, k), bool)
                bits = np.packbits(open_, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["row"], batch["cells"], batch["cluster"], pa.array(open_.sum(axis=1), pa.int32()), pa.array(open_.argmax(axis=1) if len(packed) else [], pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())],
                    names=["row", "cells", "cluster", "open", "candidate", "bits"],
                )

        return run

    def settled(centroids: np.ndarray, first_time: bool):
        """Settles rows whose vector is at hand; ``delta``, what a batch moves, stands in its first row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["vector"], size, np.int64)
                if first_time:
                    open_, before = possible(cells, _packed(batch["cells"], width), centroids), np.full(len(x), -1)
                else:
                    open_ = np.unpackbits(_packed(batch["bits"], -(-k // 8)), axis=1)[:, :k].astype(bool)
                    before = batch["cluster"].to_numpy().astype(np.int64)
                at, _ = nearest(x, centroids, open_)
                delta = pa.array([_moved(before, at, x, k), *[None] * (len(x) - 1)], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch["row"], batch["cells"], pa.array(at, pa.int32()), delta], names=["row", "cells", "cluster", "delta"])

        return run

    state_columns = "row long, cells binary, cluster int, delta array<array<long>>"
    sums = np.zeros((k, size + 1), object)
    state = None
    for turn in range(rounds):
        if turn == 0:
            new = stage(file.select("row", "cells", "vector").mapInArrow(settled(centroids, True), state_columns), "va-state")
            state = new.select("row", "cells", "cluster")
        else:
            told = state.mapInArrow(bounded(centroids), "row long, cells binary, cluster int, open int, candidate int, bits binary")
            told = stage(told, "va-bounds")
            sure = (F.col("open") == 1) & (F.col("candidate") == F.col("cluster"))
            wanted = told.where(~sure).select("row", "cells", "cluster", "bits")
            if wanted.count() <= FETCH:
                wanted = F.broadcast(wanted)
            full = file.select("row", "vector").join(wanted, "row").select("row", "cells", "cluster", "bits", "vector")
            new = stage(full.mapInArrow(settled(centroids, False), state_columns), "va-fetched")
            state = told.where(sure).select("row", "cells", "cluster").unionByName(new.select("row", "cells", "cluster"))
        sums = sums + _total(new.where("delta IS NOT NULL").select("delta"), k, size)
        centroids = _replaced(centroids, sums)
    out = file.select("key", "vector", "cells").mapInArrow(measured(centroids), "key long, cluster int, distance long")
    return out, centroids


def clusters(vectors: DataFrame, key: str, first: str, **shape) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and the centroid (integers) of every vector that takes part."""
    found, centroids = cluster(vectors, key, first, **shape)
    found = stage(found, "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row a centroid
    of = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(max(len(centroids), 1))])
    places = F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in centroids]) if len(centroids) else F.array(F.array().cast("array<int>"))
    return found.select(
        F.col("key").alias(key), "cluster", "distance", of[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), places[F.col("cluster")].alias("centroid")
    )
