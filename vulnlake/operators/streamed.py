"""Queries against a table in bounded tasks: a task holds some queries and lets a part of the rows pass by.

A join of queries with rows makes a row for each pair, or copies each query to each place where an
answer may lie. Here the queries are cut into shards that fit a task and the rows into splits; every
(shard, split) is one task, which emits the best few of each of its queries and nothing else. So what
is shuffled is the rows once per shard, and the queries and their results once per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDING = 1e-6  # a score this far below another may still equal it once both are rounded
ROOM = 1 << 20
OUT_ROWS = 50_000


def meet(queries: DataFrame, rows: DataFrame, shard: Column, shards: int, split: Column, splits: int, *order: str) -> DataFrame:
    """Partitions that each hold the queries of one shard (``_side`` 0), then the rows of one split (1) in ``order``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", F.lit(0).alias("_side"), shard.cast("int").alias("_shard"), every(splits).alias("_split"))
    given = rows.select("*", F.lit(1).alias("_side"), split.cast("int").alias("_split"), every(shards).alias("_shard"))
    both = asked.unionByName(given, allowMissingColumns=True)
    return both.repartitionById(shards * splits, F.col("_shard") * splits + F.col("_split")).sortWithinPartitions("_side", *order)


def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches of such a partition, each of one side."""
    for batch in batches:
        cut = int(np.searchsorted(batch["_side"].to_numpy(zero_copy_only=False), 1))
        for side, part in ((0, batch.slice(0, cut)), (1, batch.slice(cut))):
            if len(part):
                yield side, part


class Best:
    """The ``k`` best of each query among candidates that pass by: highest score first, ties to the smaller id.

    ``limit`` is what a candidate must reach; it rises as better ones are found. Where candidates come
    ``in_order`` of their ids, later ones must be better, not equal.
    """

    def __init__(self, queries: int, k: int, limit: np.ndarray | None = None, in_order: bool = False):
        self.k = k
        self.in_order = in_order
        self.limit = np.full(queries, -np.inf) if limit is None else limit
        self._found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = 0
        self._room = max(ROOM, queries * k)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._found.append((query, score, ids))
        self._held += len(query)
        if self._held > self._room:
            self.settle()

    def settle(self) -> None:
        """Drop what cannot stay, and raise the limits."""
        if not self._found:
            return
        query, score, ids = (np.concatenate(x) for x in zip(*self._found))
        if self.in_order:
            order = np.lexsort((-score, query))  # stable
        else:
            rank = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
            order = np.lexsort((rank, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.limit[query[last]] = np.maximum(self.limit[query[last]], score[last] + (0.4 if self.in_order else -1.0) * ROUNDING)
        kept = place < self.k
        self._found = [(query[kept], score[kept], ids[kept])]
        self._held = int(kept.sum())
        self._room = self._held + max(ROOM, len(self.limit) * self.k)

    def batches(self, query_ids: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """``query_id, chunk_id, score`` of the best."""
        if not self._found:
            return
        self.settle()
        query, score, ids = self._found[0]
        for at in range(0, len(query), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            columns = [query_ids.take(pa.array(query[part])), pa.array(ids[part], id_type), pa.array(score[part])]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])
