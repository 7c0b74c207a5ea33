"""Similarity cache: keys, lookup, retention, append."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.domain import CACHE_SIZE, CACHE_THRESHOLD
from vulnlake.operators.ranking import top_k


def cache_key(finding_type: Column, snippet: Column) -> Column:
    """Type, a bar and the first 200 characters of the snippet (a fixed key format)."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(finding_type, empty),
        F.lit("|"),
        F.substring(F.coalesce(snippet, empty), 1, 200),
    )


def fifo_retain(cache: DataFrame, max_size: int = CACHE_SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``max_size`` entries by ``seq``, of the whole cache or per key."""
    if by:
        return top_k(cache, by, [F.desc("seq")], max_size, rank="_nth").drop("_nth")
    return cache.orderBy(F.desc("seq")).limit(max_size)


def cache_lookup(
    keys: DataFrame,
    cache: DataFrame,
    threshold: float = CACHE_THRESHOLD,
    max_size: int = CACHE_SIZE,
    vector: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """J5 + W3: first cache entry in insertion order with cosine >= ``threshold``.

    Returns (hits, misses): the key rows with ``hit_seq, hit_key, result, similarity``,
    and the key rows without a hit. The cache holds at most ``max_size`` entries by
    contract (W4 is applied first), so it travels with the tasks and each Arrow batch of
    keys is one matrix product: no join, no pairs. A missing or zero vector never hits.
    """
    # At most max_size rows.
    entries = [r for r in fifo_retain(cache, max_size).orderBy("seq").collect() if r[vector] is not None]
    units = [_unit(r[vector]) for r in entries]
    entries = [e for e, u in zip(entries, units) if u is not None]
    stored = np.array([u for u in units if u is not None])
    schema = T.StructType(
        [
            T.StructField("hit_seq", T.LongType()),
            T.StructField("hit_key", T.StringType()),
            T.StructField("result", cache.schema["result"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    seqs = np.array([int(e["seq"]) for e in entries])
    names, results = (np.array([e[c] for e in entries] or [None], dtype=object) for c in ("key", "result"))

    def first_hit(vectors: pd.Series) -> pd.DataFrame:
        """One matrix product per batch; the first entry that reaches the threshold is an argmax."""
        hit, first, alike = np.zeros(len(vectors), bool), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        units = [None if v is None else _unit(v) for v in vectors]
        rows = np.flatnonzero([u is not None for u in units])
        if len(rows) and len(stored):
            cosines = np.stack([units[i] for i in rows]) @ stored.T
            reached = cosines >= threshold
            first[rows], hit[rows] = reached.argmax(axis=1), reached.any(axis=1)
            alike[rows] = cosines[np.arange(len(rows)), first[rows]]
        return pd.DataFrame(
            {
                "hit_seq": pd.Series(seqs[first] if len(seqs) else 0, range(len(vectors)), dtype="int64").astype("Int64").where(hit),
                "hit_key": np.where(hit, names[first], None),
                "result": np.where(hit, results[first], None),
                "similarity": np.where(hit, alike, np.nan),
            }
        )

    looked = keys.withColumn("_hit", F.pandas_udf(first_hit, schema)(F.col(vector)))
    found = F.col("_hit.hit_seq").isNotNull()
    hits = looked.where(found).select(*keys.columns, "_hit.*")
    return hits, looked.where(~found).select(*keys.columns)


def _unit(vector) -> np.ndarray | None:
    v = np.asarray(vector, dtype=np.float64)
    length = np.sqrt(v @ v)
    return v / length if length > 0 else None


def cache_append(
    cache: DataFrame, fresh: DataFrame, max_size: int = CACHE_SIZE, order: str = "arrival"
) -> DataFrame:
    """Store new results; an existing key is replaced in place, then W4.

    ``fresh`` holds ``key, embedding, result`` and the arrival order; the last result of
    a key wins, its place is that of its first arrival. Only the newest ``max_size`` new
    keys can survive, so numbering happens after that cut, on a bounded set.
    """
    last = fresh.groupBy("key").agg(
        F.min(order).alias("_first"),
        F.max_by(F.struct("embedding", "result"), F.col(order)).alias("_value"),
    )
    replaced = (
        cache.join(last.select("key", "_value"), "key", "left")
        .select(
            "seq",
            "key",
            F.coalesce("_value.embedding", "embedding").alias("embedding"),
            F.coalesce("_value.result", "result").alias("result"),
        )
    )
    new = last.join(cache.select("key"), "key", "left_anti")
    base = cache.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    count = new.agg(F.count("*")).scalar()
    newest = new.orderBy(F.desc("_first")).limit(max_size)
    nth_last = F.row_number().over(W.orderBy(F.desc("_first")))  # at most max_size rows
    numbered = newest.select(
        (base + count - nth_last + 1).cast("bigint").alias("seq"),
        "key",
        F.col("_value.embedding").alias("embedding"),
        F.col("_value.result").alias("result"),
    )
    return fifo_retain(replaced.unionByName(numbered), max_size)


def cache_stats(
    cache: DataFrame, max_size: int = CACHE_SIZE, threshold: float = CACHE_THRESHOLD, enabled: bool = True
) -> DataFrame:
    """One row with size, capacity and threshold."""
    return cache.agg(F.count("*").alias("cache_size")).select(
        F.lit(enabled).alias("cache_enabled"),
        "cache_size",
        F.lit(max_size).alias("max_size"),
        F.lit(threshold).alias("similarity_threshold"),
    )
