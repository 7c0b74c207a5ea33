"""Vector candidates (J2) and maximal marginal relevance (K2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.domain import MMR_LAMBDA, VECTOR_FETCH_K, VECTOR_K
from vulnlake.operators.ranking import top_k
from vulnlake.operators.streamed import Best, meet, sides
from vulnlake.session import stage

_SLACK = 1e-5
PIVOT_SHARE = 4  # the root of the rows over this is the number of pivots
BLOCK_ROWS = 1024
SHARD_BLOCKS = 64
HELD_BYTES = 32 << 20  # queries and results of a task of the exact search
TASK_PAIRS = 1 << 28  # pairs that are worth a task of it
TASK_ROWS = 1 << 16  # or rows
SCAN_TASKS = 4  # tasks a core
TILE = 512


@F.pandas_udf(T.BinaryType())
def _unit_bytes(vectors: pd.Series) -> pd.Series:
    """Unit vector as packed float64; null for a missing or zero vector."""

    def pack(v) -> bytes | None:
        if v is None:
            return None
        a = np.asarray(v, dtype=np.float64)
        length = np.sqrt(a @ a)
        return (a / length).tobytes() if length > 0 else None

    return vectors.map(pack)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


@dataclass(frozen=True)
class Pivots:
    """Two levels of directions: groups, and the pivots (clusters) of each group.

    Their number grows with the root of the rows, so this is what the driver holds. ``low`` and
    ``high`` are the angles between a direction and the rows below it.
    """

    units: np.ndarray
    group: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    group_units: np.ndarray
    group_low: np.ndarray
    group_high: np.ndarray

    @property
    def members(self) -> list[np.ndarray]:
        """Clusters with rows, by group."""
        return [np.flatnonzero((self.group == g) & (self.size > 0)) for g in range(len(self.group_units))]


@dataclass(frozen=True)
class VectorIndex:
    """``blocks(cluster, shard, ids, units)`` and the pivots they belong to."""

    blocks: DataFrame
    pivots: Pivots


def _grouped(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each pivot, and the groups' directions: about the root of their number, each with a pivot."""
    heads = units[: max(1, int(np.sqrt(len(units))))]
    group = (units @ heads.T).argmax(axis=1)
    used, group = np.unique(group, return_inverse=True)
    return group.ravel(), heads[used]


def _placed(units: DataFrame, pivot_units: np.ndarray, group: np.ndarray, group_units: np.ndarray) -> DataFrame:
    """Rows with their cluster (nearest pivot of the nearest group) and both angles."""
    members = [np.flatnonzero(group == g) for g in range(len(group_units))]

    @F.pandas_udf("cluster int, angle double, group_angle double")
    def assign(blobs: pd.Series) -> pd.DataFrame:
        cluster = np.zeros(len(blobs), np.int64)
        angle, group_angle = np.zeros(len(blobs)), np.zeros(len(blobs))
        if len(blobs):
            x = _matrix(blobs.tolist())
            angles = _angles(x, group_units)
            near = angles.argmin(axis=1)
            group_angle = angles.min(axis=1)
            for g in np.unique(near):
                rows = np.flatnonzero(near == g)
                inner = _angles(x[rows], pivot_units[members[g]])
                cluster[rows], angle[rows] = members[g][inner.argmin(axis=1)], inner.min(axis=1)
        return pd.DataFrame({"cluster": cluster.astype("int32"), "angle": angle, "group_angle": group_angle})

    return units.withColumn("_at", assign("unit")).select("id", "unit", "_at.cluster", "_at.angle", "_at.group_angle")


def _shape(placed: DataFrame, pivot_units: np.ndarray, group: np.ndarray, group_units: np.ndarray) -> Pivots:
    """Sizes and angle ranges: one row per pivot comes to the driver."""
    size = np.zeros(len(pivot_units), np.int64)
    low, high = np.zeros(len(pivot_units)), np.zeros(len(pivot_units))
    group_low, group_high = np.full(len(group_units), np.inf), np.zeros(len(group_units))
    seen = placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("group_angle").alias("glo"), F.max("group_angle").alias("ghi")
    )
    for r in seen.collect():
        c, g = r["cluster"], group[r["cluster"]]
        size[c], low[c], high[c] = r["n"], r["lo"], r["hi"]
        group_low[g], group_high[g] = min(group_low[g], r["glo"]), max(group_high[g], r["ghi"])
    return Pivots(pivot_units, group, size, low, high, group_units, group_low, group_high)


def _counted_by(cluster: str, counts: np.ndarray) -> Column:
    """A number of the row's cluster, looked up in an array of one number per pivot."""

    @F.pandas_udf("int")
    def look(clusters: pd.Series) -> pd.Series:
        return pd.Series(counts[clusters.to_numpy()].astype("int32"))

    return look(F.col(cluster))


def _blocks(rows: DataFrame, sizes: np.ndarray, block_rows: int) -> DataFrame:
    """Rows packed per cluster into hash blocks of about ``block_rows`` rows each, so a
    cluster of any size becomes many bounded blocks."""
    n_blocks = _counted_by("cluster", np.maximum(1, -(-sizes // block_rows)))
    block = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
    return rows.groupBy("cluster", block.alias("block")).agg(
        F.collect_list("id").alias("ids"), F.collect_list("unit").alias("units")
    )


def unit_rows(chunks: DataFrame, chunk_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``id, unit`` of the rows with a vector of some length."""
    units = chunks.select(F.col(chunk_id).alias("id"), _unit_bytes(F.col(vector)).alias("unit"))
    return units.where(F.col("unit").isNotNull())


def vector_blocks(units: DataFrame, pivots: Pivots, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Pivots]:
    """Blocks of ``units`` under given pivots, and the pivots with the sizes and ranges of these rows."""
    placed = stage(_placed(units, pivots.units, pivots.group, pivots.group_units), "vector-places")
    shape = _shape(placed, pivots.units, pivots.group, pivots.group_units)
    blocks = _blocks(placed.select("id", "unit", "cluster"), shape.size, block_rows)
    shard = F.floor(F.col("block") / SHARD_BLOCKS).cast("int")
    return blocks.select("cluster", shard.alias("shard"), "ids", "units"), shape


def choose_pivots(units: DataFrame) -> Pivots | None:
    """Pivots for a table of units (none where it is empty): rows taken by a hash of their id."""
    total = units.count()
    if total == 0:
        return None
    wanted = max(1, int(np.sqrt(total) / PIVOT_SHARE))
    picked = _matrix([r["unit"] for r in units.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])
    group, heads = _grouped(picked)
    none = np.zeros(len(picked))
    return Pivots(picked, group, none.astype(np.int64), none, none, heads, np.zeros(len(heads)), np.zeros(len(heads)))


def build_vectors(chunks: DataFrame, vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> VectorIndex | None:
    """Index of the chunks' vectors for ``vector_topk``; None where no chunk has one."""
    units = stage(unit_rows(chunks, vector=vector), "vector-units")
    pivots = choose_pivots(units)
    if pivots is None:
        return None
    blocks, pivots = vector_blocks(units, pivots, block_rows)
    return VectorIndex(stage(blocks, "vector-blocks"), pivots)


def _search(routes: DataFrame, index: VectorIndex, k: int, block_rows: int) -> DataFrame:
    """Best ``k`` per query block and chunk block of the same cluster.

    Joined rows are pairs of blocks; each emits at most ``k`` rows per query, never the
    pairs themselves. The join key is (cluster, shard): a large cluster has one shard per
    ``SHARD_BLOCKS`` blocks, and its query blocks go to each of them.
    """
    sizes = np.zeros(len(index.pivots.size), np.int64)
    for r in routes.groupBy("cluster").agg(F.count("*").alias("n")).collect():  # one row per pivot at most
        sizes[r["cluster"]] = r["n"]
    last = index.blocks.groupBy("cluster").agg(F.max("shard").alias("_last"))
    query_blocks = _blocks(routes, sizes, block_rows).join(last, "cluster").select(
        "cluster",
        F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("shard"),
        F.col("ids").alias("query_ids"),
        F.col("units").alias("query_units"),
    )
    chunk_blocks = index.blocks.select("cluster", "shard", F.col("ids").alias("chunk_ids"), F.col("units").alias("chunk_units"))
    pairs = query_blocks.join(chunk_blocks, ["cluster", "shard"])
    schema = T.StructType(
        [
            T.StructField("query_id", routes.schema["id"].dataType),
            T.StructField("chunk_id", index.blocks.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                query_ids, chunk_ids = np.asarray(row.query_ids), np.asarray(row.chunk_ids)
                by_id = np.argsort(chunk_ids, kind="stable")
                chunk_ids = chunk_ids[by_id]
                scores = _round6(_matrix(row.query_units) @ _matrix(row.chunk_units)[by_id].T)
                # Stable sort on columns in id order: ties fall to the smaller id.
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(query_ids, top.shape[1]),
                        "chunk_id": chunk_ids[top].ravel(),
                        "score": np.take_along_axis(scores, top, axis=1).ravel(),
                    }
                )

    columns = ["query_ids", "query_units", "chunk_ids", "chunk_units"]
    return pairs.select(*columns).mapInPandas(best, schema)


def _near(angles: np.ndarray, x: np.ndarray, p: Pivots, members: list[np.ndarray], k: int, probes: int) -> np.ndarray:
    """Clusters that a query searches first: the nearest ones until they hold ``k`` rows (and are ``probes``)."""
    chosen, rows, count = [], 0, 0
    for g in np.argsort(angles, kind="stable"):
        if rows >= k and count >= probes:
            break
        chosen.append(members[g])
        rows, count = rows + p.size[members[g]].sum(), count + len(members[g])
    clusters = np.concatenate(chosen)
    clusters = clusters[np.argsort(_angles(x[None], p.units[clusters])[0], kind="stable")]
    held = np.cumsum(p.size[clusters]) - p.size[clusters]
    return clusters[(held < k) | (np.arange(len(clusters)) < probes)]


def _gap(angles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.clip(np.maximum(angles - high, low - angles), 0.0, np.pi)


def _near_clusters(p: Pivots, k: int, probes: int | None):
    """A column function giving the clusters that a query searches first."""
    members = p.members

    @F.pandas_udf("array<int>")
    def route(blobs: pd.Series) -> pd.Series:
        out = []
        if len(blobs):
            x = _matrix(blobs.tolist())
            angles = _angles(x, p.group_units)
            out = [_near(angles[q], x[q], p, members, k, probes or 0).tolist() for q in range(len(x))]
        return pd.Series(out, dtype="object")

    return route


def _scanned(asked: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Best ``k`` per query (``id, unit, limit``) and task, among all rows that reach the limit.

    A task holds a shard of the queries, at most ``HELD_BYTES`` with their results, and the blocks
    of a split pass by in the order of their clusters. A cluster meets only the queries whose limit, by
    the triangle inequality, it can reach; limits rise as better rows are found. Queries are not copied to
    clusters, and no row is made for a pair.
    """
    pivots, width = index.pivots, 8 * index.pivots.units.shape[1]
    n, against = asked.count(), int(pivots.size.sum())
    tasks = min(SCAN_TASKS * asked.sparkSession.sparkContext.defaultParallelism, max(1, n * against // TASK_PAIRS, against // TASK_ROWS))
    # rows travel once a shard, queries and their results once a split: as many shards as make the least of it
    even = np.sqrt(tasks * n * (width + 20 * k) / max(1, against * width))
    shards = max(1, -(-n * (width + 16 * k) // HELD_BYTES), min(tasks, round(even)))
    splits = -(-tasks // shards)
    queries = asked.select(F.col("id").alias("query_id"), "limit", F.array("unit").alias("units"))
    blocks = index.blocks.select("cluster", F.col("ids").alias("chunk_ids"), "units")
    shard = F.pmod(F.xxhash64("query_id"), F.lit(shards))
    split = F.pmod(F.xxhash64("cluster", F.get("chunk_ids", F.lit(0))), F.lit(splits))
    met = meet(queries, blocks, shard, shards, split, splits, "cluster")
    rows = met.select("_side", "query_id", "limit", "cluster", "chunk_ids", F.posexplode("units").alias("_i", "unit"))
    rows = rows.select("_side", "query_id", "limit", "cluster", F.get("chunk_ids", F.col("_i")).alias("chunk_id"), "unit")
    schema = T.StructType(
        [T.StructField("query_id", asked.schema["id"].dataType), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], None
        for side, batch in sides(batches):
            if side == 0:
                held.append(batch)
                continue
            if found is None:
                if not held:
                    return
                table = pa.Table.from_batches(held).combine_chunks()
                query_ids, units = table["query_id"].combine_chunks(), _matrix(table["unit"].to_pylist())
                limit = table["limit"].to_numpy().astype(np.float64)
                found = Best(len(units), k, np.where(np.isnan(limit), -np.inf, limit))
                id_type = batch.schema.field("chunk_id").type
            x, ids = _matrix(batch["unit"].to_pylist()), batch["chunk_id"].to_numpy(zero_copy_only=False)
            clusters = batch["cluster"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, clusters[1:] != clusters[:-1]))
            for start, end in zip(starts, np.append(starts[1:], len(clusters))):
                c = clusters[start]
                near = _gap(_angles(units, pivots.units[c][None])[:, 0], pivots.low[c], pivots.high[c])
                reached = np.flatnonzero(np.cos(near) >= found.limit)
                for a in range(0, len(reached), TILE):
                    some = reached[a:a + TILE]
                    own = units[some]
                    for b in range(start, end, 2 * TILE):
                        rows = slice(b, min(b + 2 * TILE, end))
                        scores = own @ x[rows].T
                        hits = np.flatnonzero(scores >= found.limit[some][:, None])
                        if len(hits):
                            q, r = np.divmod(hits, scores.shape[1])
                            found.add(some[q], _round6(scores.ravel()[hits]), ids[rows][r])
        if found is not None:
            yield from found.batches(query_ids, id_type)

    return rows.mapInArrow(best, schema)


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame | None = None,
    k: int = VECTOR_FETCH_K,
    vector: str = "embedding",
    probes: int | None = None,
    block_rows: int = BLOCK_ROWS,
    index: VectorIndex | None = None,
) -> DataFrame:
    """The ``k`` chunks of highest cosine per query -> ``query_id, chunk_id, score, rank``.

    Exact unless ``probes`` is given. ``score`` is rounded to six decimals, ties go to
    the smaller chunk id; missing and zero vectors never match.

    Chunks belong to pivots, whose number grows with the root of the rows, and pivots to groups.
    A query first searches the clusters around its nearest pivots until it has ``k`` rows; its
    k-th score is then the limit with which it meets all blocks (see ``_scanned``): a cluster whose
    angle range (triangle inequality on the sphere) cannot hold anything as good is not compared. Within
    a cluster the work is block by block, so a cluster with a third of the rows is just more blocks.
    ``probes`` searches the nearest clusters only, and further ones until they hold ``k`` rows:
    approximate, one pass. ``index`` is searched as it is; without it one is built of ``chunks``.
    """
    asked = stage(unit_rows(queries, "query_id", vector), "vector-queries")
    if index is None:
        index = build_vectors(chunks, vector, block_rows)
    if index is None:
        chunk_type = T.LongType() if chunks is None else chunks.schema["chunk_id"].dataType
        schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    near = _near_clusters(index.pivots, k, probes)
    order = [F.desc("score"), F.col("chunk_id")]
    first = _search(asked.select("id", "unit", F.explode(near("unit")).alias("cluster")), index, k, block_rows)
    best = top_k(first, ["query_id"], order, k)
    if probes is not None:
        return best
    limits = best.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score") - _SLACK).alias("limit")
    )
    bounded = asked.join(limits.withColumnRenamed("query_id", "id"), "id", "left")
    # a few rows a query, which callers read several times
    return stage(top_k(_scanned(bounded, index, k), ["query_id"], order, k), "vector-best")


def mmr(
    candidates: DataFrame, k: int = VECTOR_K, lambda_: float = MMR_LAMBDA, vector: str = "embedding"
) -> DataFrame:
    """K2: choose ``k`` of each query's candidates, relevant but unlike each other.

    Reads ``query_id, chunk_id, score, rank`` and the chunk vector. The first pick is
    the most relevant; each next one maximises ``lambda * relevance - (1 - lambda) *
    closest similarity to a pick``, ties to the better candidate rank. A query's
    candidates are a bounded top-k, so one array per query is small, and a whole Arrow
    batch of queries is handled per call.
    """
    packed = (
        candidates.select("query_id", "chunk_id", "score", "rank", _unit_bytes(F.col(vector)).alias("unit"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "unit"))).alias("_c"))
        .select(
            "query_id",
            F.col("_c.chunk_id").alias("chunk_ids"),
            F.col("_c.score").alias("scores"),
            F.col("_c.unit").alias("units"),
        )
    )
    schema = T.StructType(
        [
            candidates.schema["query_id"],
            candidates.schema["chunk_id"],
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                units, rel = _matrix(row.units), np.asarray(row.scores, dtype=np.float64)
                alike = units @ units.T
                picks = [0]
                while len(picks) < min(k, len(rel)):
                    gain = _round6(lambda_ * rel - (1 - lambda_) * alike[:, picks].max(axis=1))
                    gain[picks] = -np.inf
                    picks.append(int(gain.argmax()))
                rows += [(row.query_id, row.chunk_ids[p], rel[p], i + 1) for i, p in enumerate(picks)]
            yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "score", "rank"])

    return packed.mapInPandas(choose, schema)
