"""Bounded similarity cache over a stream of findings, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vulnlake.domain import CACHE_SIZE, CACHE_THRESHOLD

STATE_SCHEMA = "seq bigint, embedding array<double>"


class _Shelf:
    """At most ``size`` stored vectors in insertion order."""

    def __init__(self, threshold: float, size: int, entries: Iterable[tuple[int, np.ndarray]] = ()) -> None:
        self.threshold, self.size = threshold, size
        self.entries = [(seq, np.asarray(v, dtype=np.float64)) for seq, v in entries]

    def ask(self, seq: int, vector) -> tuple[bool, int | None, float | None]:
        """(hit, seq of the stored entry, similarity); a miss is stored."""
        v = np.asarray([] if vector is None else vector, dtype=np.float64)
        length = np.sqrt(v @ v)
        if self.entries and length > 0:
            stored = np.stack([e for _, e in self.entries])
            norms = np.sqrt((stored * stored).sum(axis=1)) * length
            alike = np.divide(stored @ v, norms, out=np.full(len(norms), -np.inf), where=norms > 0)
            reached = np.flatnonzero(alike >= self.threshold)
            if len(reached):
                first = reached[0]
                return True, self.entries[first][0], float(alike[first])
        if len(v):
            if len(self.entries) >= self.size:
                self.entries.pop(0)
            self.entries.append((seq, v))
        return False, None, None


def _output(source: DataFrame, key: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField("seq", T.LongType()),
            T.StructField("hit", T.BooleanType()),
            T.StructField("hit_seq", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _frame(rows: list[tuple], key: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[key, "seq", "hit", "hit_seq", "similarity"])
    return frame.astype({"hit_seq": "Int64", "similarity": "float64"})


class _CacheProcessor(StatefulProcessor):
    def __init__(self, key: str, threshold: float, size: int) -> None:
        self.key, self.threshold, self.size = key, threshold, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("entries", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shelf = _Shelf(self.threshold, self.size, [tuple(e) for e in self.state.get()])
        before = [seq for seq, _ in shelf.entries]
        # All rows of the key and trigger, so that the order does not depend on Arrow batches;
        # the source's rate limit bounds them.
        asked = sorted(((s, v) for batch in rows for s, v in zip(batch["seq"], batch["embedding"])), key=lambda r: r[0])
        yield _frame([(key[0], s, *shelf.ask(s, v)) for s, v in asked], self.key)
        # entries that came are appended; the list is written anew only where some had to leave
        entries = [(int(s), v.tolist()) for s, v in shelf.entries]
        if [s for s, _ in entries[: len(before)]] != before:
            self.state.put(entries)
        elif len(entries) > len(before):
            self.state.appendList(entries[len(before) :])

    def close(self) -> None:
        pass


def stream_cache(
    stream: DataFrame, key: str = "type", threshold: float = CACHE_THRESHOLD, max_size: int = CACHE_SIZE
) -> DataFrame:
    """Answer each finding from the bounded cache of its key, or store it as a miss.

    Reads ``key, seq, embedding``. The first stored entry with cosine >= ``threshold``
    answers; a miss is stored and the oldest entry leaves at ``max_size``. The cache is
    per key value, since a hit depends on all earlier misses of the key and one global
    cache could not be spread. Rows are ordered by ``seq`` within a trigger.
    """
    return (
        stream.select(key, F.col("seq").cast("bigint").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
        .groupBy(key)
        .transformWithStateInPandas(
            _CacheProcessor(key, threshold, max_size),
            outputStructType=_output(stream, key),
            outputMode="Append",
            timeMode="None",
        )
    )


def batch_cache(
    findings: DataFrame, key: str = "type", threshold: float = CACHE_THRESHOLD, max_size: int = CACHE_SIZE
) -> DataFrame:
    """X1, batch twin: the same answers for a table, in ``seq`` order.

    Rows are sorted by key and ``seq`` and streamed through Python, so a task holds one
    bounded cache and one Arrow batch, never a whole key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shelf = None, None
        for batch in batches:
            out = []
            for value, seq, vector in zip(batch[key], batch["seq"], batch["embedding"]):
                if shelf is None or value != current:
                    current, shelf = value, _Shelf(threshold, max_size)
                out.append((value, seq, *shelf.ask(seq, vector)))
            yield _frame(out, key)

    ordered = (
        findings.select(key, F.col("seq").cast("bigint").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
        .repartition(key)
        .sortWithinPartitions(key, "seq")
    )
    return ordered.mapInPandas(run, _output(findings, key))
