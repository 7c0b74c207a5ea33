"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

* The tree is fitted on a bounded sample; every row is indexed under the leaf it descends to.
  Leaves are stored as blocks of bounded size, so a hot leaf is many blocks.
* A query walks the tree through a priority queue: the open node with the largest inner
  product with its centre is opened next, its own key being no larger than its parent's. Leaves
  come out in falling order of key; the walk ends where a leaf's key lies more than ``width``
  (times the query's norm) below the first leaf's.
* ``width`` is calibrated: for a bounded number of queries the exact neighbours are found by
  one pass over all rows, and the width grows until their mean recall reaches ``recall``. So a
  query amid a tight cluster visits few leaves and one without near neighbours many.
* Visited leaves and blocks meet in a join; matrix products make a shortlist that is scored
  again in double precision with a fixed order of summation, so that ties are exact.

Defined cases: vectors that are null, zero, of another length than the usual one, or that hold
null or non-finite components take no part, nor do rows without an id; rows that repeat an id
are one row (the smallest vector). With no more candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.llm.common import hash_share
from vulnlake.session import stage

BRANCH = 12
LEAVES, MOST_LEAVES = 256, 8192  # about the root of the rows, between these; a leaf has at least LEAST sampled rows
SAMPLE, PER_LEAF = 20_000, 40  # rows the tree is fitted on: so many at least, and for each leaf (330,000 at most)
LEAST = 24
BLOCK = 2048  # rows of a stored block
PACK = 256  # queries that meet a block together
CALIBRATION = 128  # queries with exact neighbours
RECALL = 0.97
FLUSH = 200_000


@dataclass
class Tree:
    """Nodes in one array: centres, and children's node numbers (none for a leaf); node 0 is the root."""

    centres: np.ndarray
    children: list[list[int]]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf whose path has the nearest centre at every level."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = [n for n in np.unique(at).tolist() if self.children[n]]
            if not inner:
                return at
            for n in inner:
                rows = np.flatnonzero(at == n)
                kids = np.array(self.children[n])
                c = self.centres[kids]
                at[rows] = kids[((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)]

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves best-bin-first, with their keys (falling)."""
        match = self.centres @ query
        heap = [(-np.inf, 0)]
        while heap:
            key, node = heapq.heappop(heap)
            if not self.children[node]:
                yield node, -key
            for child in self.children[node]:
                heapq.heappush(heap, (max(key, -float(match[child])), child))

    def visited(self, query: np.ndarray, width: float, counts: dict[int, int], least: int) -> list[int]:
        """Leaves within ``width`` of the first, and further ones until they hold ``least`` rows (``counts``: rows of each leaf)."""
        out, limit, held = [], -np.inf, 0
        for leaf, key in self.walk(query):
            if not out:
                limit = key - width * float(np.linalg.norm(query)) - 1e-12
            if key < limit and held >= least:
                break
            out.append(leaf)
            held += counts.get(leaf, 0)
        return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for j in range(k):
            own = x[near == j]
            if len(own):
                centres[j] = own.mean(axis=0)
    return centres


def fit(x: np.ndarray, leaves: int = LEAVES, branch: int = BRANCH, seed: int = 3) -> Tree:
    """Splits the sample until a node has no more than its share of rows, or its rows are all alike."""
    rng = np.random.default_rng(seed)
    most = max(LEAST, len(x) // leaves)
    centres, children, open_ = [x.mean(axis=0) if len(x) else np.zeros(0)], [[]], [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        own = x[rows]
        if len(rows) <= most or np.ptp(own, axis=0).max() < 1e-12:
            continue
        c = _k_means(own, min(branch, -(-len(rows) // max(most // 2, 1))), rng)
        near = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            continue
        for j in used.tolist():
            children.append([])
            centres.append(c[j])
            children[node].append(len(centres) - 1)
            open_.append((len(centres) - 1, rows[near == j]))
    return Tree(np.array(centres), children)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows but the query's own; ``scores`` may be off by rounding."""
    slack = 1e-9 * (1 + float(np.abs(scores).max(initial=0)))
    keep = k + 1
    rows = np.arange(len(ids)) if len(ids) <= keep else np.flatnonzero(scores >= np.partition(scores, -keep)[-keep] - slack)
    rows = rows[ids[rows] != own]
    exact = (x[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][order], exact[order]


def _merge(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[np.ndarray]:
    """The k best of each query among collected (query, id, score)."""
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return [c[rank < k] for c in (q, i, s)]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _collected(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Batches of a task's results, the k best of each query where they fit into memory together."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > FLUSH:
            merged = _merge(held, k)
            held, size = [tuple(merged)], len(merged[0])
            if size > FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged], schema=_FOUND)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _merge(held, k)], schema=_FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The k nearest of a bounded list of queries, by one pass over all rows."""
    ids, q = np.array([i for i, _ in queries]), np.array([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                x, own = _matrix(batch["v"], q.shape[1]), batch["id"].to_numpy()
                scores = q @ x.T
                for j in range(len(ids)):
                    i, s = _best(x, own, q[j], ids[j], scores[j], k)
                    yield np.full(len(i), ids[j]), i, s

        return _collected(parts(), k)

    return _ranked(rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrated_width(tree: Tree, rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> float:
    """The smallest width at which the calibration queries' mean recall reaches ``recall``."""
    if not queries:
        return 0.0
    truth = exact_neighbours(rows, queries, k).select("query_id", F.col("vec_id").alias("id"))
    owners: dict[int, list[int]] = {}
    for r in rows.select("id", "leaf").join(F.broadcast(truth), "id").select("query_id", "leaf").collect():
        owners.setdefault(r.query_id, []).append(r.leaf)
    gaps, weights, total = [], [], 0
    for i, q in queries:
        mine = owners.get(i, [])
        if not mine:
            continue
        keys = dict(tree.walk(q))
        top = max(keys.values())
        gaps += [(top - keys[leaf]) / float(np.linalg.norm(q)) for leaf in mine]
        weights += [1 / len(mine)] * len(mine)
        total += 1
    if not gaps:
        return 0.0
    order = np.argsort(gaps)
    reached = np.cumsum(np.array(weights)[order]) / total
    return float(np.array(gaps)[order][min(int(np.searchsorted(reached, recall - 1e-12)), len(gaps) - 1)])


def search(
    vectors: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, by inner product."""
    rows = usable(vectors, key, vector)
    rows = stage(rows.withColumn("query", F.coalesce(is_query(F.col("id")), F.lit(False))), "vectors")
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == width)
    # both samples are drawn by a hash of the id: about so many rows whatever the table's size
    draw = hash_share(F.col("id"), 23)
    leaves = min(MOST_LEAVES, max(LEAVES, int(np.sqrt(total))))
    sample = rows.where(draw < max(SAMPLE, PER_LEAF * leaves) / total).select("id", "v").orderBy("id").collect()
    asked = rows.where("query").count()
    tree = fit(np.array([r.v for r in sample]).reshape(-1, width), leaves)
    tuning = rows.where(F.col("query") & (draw < CALIBRATION / max(asked, 1))).select("id", "v").orderBy("id").collect()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(_matrix(batch["v"], width))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], batch["query"], pa.array(leaf)], ["id", "v", "query", "leaf"])

    rows = stage(rows.select("id", "v", "query").mapInArrow(placed, "id long, v array<double>, query boolean, leaf long"), "leaves")
    reach = calibrated_width(tree, rows, [(r.id, np.array(r.v)) for r in tuning], k, recall)

    # The index: blocks of a leaf. The number of blocks follows from the leaf's count (one row
    # a leaf), so a block holds about BLOCK rows whatever the leaf holds.
    counts = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, max(1, -(-c // BLOCK)))]), F.col("leaf"))
    shard = F.pmod(F.xxhash64("id", F.lit(29)), blocks)
    index = rows.withColumn("shard", shard).groupBy("leaf", "shard").agg(F.collect_list(F.struct("id", "v")).alias("members"))
    index = stage(index.select("leaf", "shard", F.col("members.id").alias("ids"), F.flatten("members.v").alias("values")), "blocks")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ids = _matrix(batch["v"], width), batch["id"].to_pylist()
            visits = [tree.visited(v, reach, counts, k + 1) for v in q]
            n = [len(v) for v in visits]
            pick = np.repeat(np.arange(len(ids)), n)
            for i in range(0, len(pick), 4096):
                part = pa.array(pick[i : i + 4096])
                leaf = pa.array([x for v in visits for x in v][i : i + 4096], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["id"].take(part), batch["v"].take(part), leaf], ["query_id", "q", "leaf"])

    routes = rows.where("query").select("id", "v").mapInArrow(walk, "query_id long, q array<double>, leaf long")
    packs = F.pmod(F.xxhash64("query_id", F.lit(31)), F.lit(max(1, -(-asked // PACK))))
    packed = routes.withColumn("pack", packs).groupBy("leaf", "pack").agg(F.collect_list(F.struct("query_id", "q")).alias("asking"))
    packed = stage(packed.select("leaf", F.col("asking.query_id").alias("query_ids"), F.flatten("asking.q").alias("queries")), "routes")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for row in range(len(batch)):
                    ids, query_ids = (np.array(batch[c][row].values) for c in ("ids", "query_ids"))
                    x, q = (np.array(batch[c][row].values).reshape(-1, width) for c in ("values", "queries"))
                    scores = q @ x.T
                    for j in range(len(query_ids)):
                        i, s = _best(x, ids, q[j], query_ids[j], scores[j], k)
                        yield np.full(len(i), query_ids[j]), i, s

        return _collected(parts(), k)

    # a hot leaf's blocks are spread: its packs go to each of them
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    index = index.withColumn("shard", F.col("shard").cast("long"))
    found = packed.join(index, ["leaf", "shard"]).select("ids", "values", "query_ids", "queries").mapInArrow(score, "query_id long, vec_id long, score double")
    return _ranked(found, k)
