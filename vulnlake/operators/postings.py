"""Postings in blocks, chunks with their counted terms, and exact BM25 top-k over these.

The postings of a term are ordered by impact (frequency falling, then length) and cut into blocks
of at most ``BLOCK``. A block holds its largest frequency and smallest length. As the gain of a
posting rises with the frequency and falls with the length, these two bound every gain of the
block, whatever the corpus' mean length is by the time of the search.

Beside the blocks stands the forward table, one row a chunk with its counted terms. Searches read
this one: the full score of a chunk is taken from its own row, and only the best leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.domain import BM25_B, BM25_EPSILON, BM25_K1
from vulnlake.functions.folds import bound
from vulnlake.functions.text import tokens
from vulnlake.operators.streamed import ROUNDING, Best, meet, sides

BLOCK = 128
SPREAD = 64  # join keys over which the blocks of one term are spread
LISTED = 5_000  # query terms up to which they are named in the scan's filter
SHARD_QUERIES = 2048  # queries of a task
TASK_CHUNKS = 4096  # chunks that are worth a task
TASKS_A_CORE = 4
CELLS = 1 << 20  # scores held at a time


def counted_terms(words: DataFrame) -> DataFrame:
    """``chunk_id, length, terms array<struct<term, tf>>`` from a token array ``_words`` per chunk.

    The tokens are sorted and cut into runs inside the row, so counting does not shuffle
    the corpus token by token.
    """

    def counted(s: Column) -> Column:
        first = F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i))

        def terms(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(s))
            return F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), (end(j) - a).cast("bigint").alias("tf")))

        return bound(F.filter(first, lambda i: i.isNotNull()), terms)

    # both arrays are bound, as the optimiser would else work them out again for every element
    return words.select("chunk_id", F.size("_words").alias("length"), bound(F.sort_array("_words"), counted).alias("terms"))


def forward_table(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "content") -> DataFrame:
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    return counted_terms(words)


def posting_blocks(forward: DataFrame) -> DataFrame:
    """``term, chunk_ids, tfs, lengths, top_tf, least_length``, in term order and written as such.

    One range shuffle: every task gets a range of (term, impact), and cuts its sorted rows into
    blocks as they pass by, so a frequent term is the work of several tasks.
    """
    order = [F.col("term"), F.desc("tf"), F.col("length"), F.col("chunk_id")]
    rows = forward.select("chunk_id", "length", F.inline("terms")).select("term", "tf", "length", "chunk_id")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            term = batch["term"]
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(new)
            within = np.arange(n) - runs[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % BLOCK == 0)
            offsets = pa.array(np.append(starts, n), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch[c]) for c in ("chunk_id", "tf", "length")]
            top = np.maximum.reduceat(batch["tf"].to_numpy(zero_copy_only=False), starts)
            least = np.minimum.reduceat(batch["length"].to_numpy(zero_copy_only=False), starts)
            yield pa.RecordBatch.from_arrays(
                [term.take(pa.array(starts)), *lists, pa.array(top, pa.int64()), pa.array(least, pa.int32())],
                names=["term", "chunk_ids", "tfs", "lengths", "top_tf", "least_length"],
            )

    schema = T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField("chunk_ids", T.ArrayType(forward.schema["chunk_id"].dataType)),
            T.StructField("tfs", T.ArrayType(T.LongType())),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("top_tf", T.LongType()),
            T.StructField("least_length", T.IntegerType()),
        ]
    )
    return placed.mapInArrow(cut, schema)


def term_table(blocks: DataFrame) -> DataFrame:
    """``term, df, top_tf, least_length``; tables of several parts are added up by ``merged_terms``."""
    return blocks.groupBy("term").agg(
        F.sum(F.size("chunk_ids")).alias("df"), F.max("top_tf").alias("top_tf"), F.min("least_length").alias("least_length")
    )


def merged_terms(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.max("top_tf").alias("top_tf"), F.min("least_length").alias("least_length"))


def gain_of(tf: Column, length: Column, avgdl: Column) -> Column:
    """Saturated term frequency: what one query occurrence adds, over the term's idf."""
    damping = F.lit(BM25_K1) * (1 - BM25_B + BM25_B * F.try_divide(length, avgdl))
    return tf * (BM25_K1 + 1) / (tf + damping)


def weighted_terms(terms: DataFrame, n: Column, avgdl: Column) -> DataFrame:
    """Adds ``idf`` and ``top_gain``; a negative idf becomes a quarter of the mean idf of all terms."""
    raw = terms.withColumn("_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    avg_idf = raw.agg(F.avg("_idf")).scalar()
    idf = F.when(F.col("_idf") < 0, F.lit(BM25_EPSILON) * avg_idf).otherwise(F.col("_idf"))
    return raw.select("term", "df", "top_tf", "least_length", idf.alias("idf"), gain_of(F.col("top_tf"), F.col("least_length"), avgdl).alias("top_gain"))


def blocks_of(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with a ``term`` beside its blocks.

    Few different terms are named in the filter of the scan, which then reads only the row
    groups that hold them (blocks are stored in term order). The join key holds a part of the
    blocks, so the blocks of a frequent term are not one task's work.
    """
    names = [r["term"] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    if len(names) <= LISTED:
        blocks = blocks.where(F.col("term").isin(names))
    part = F.pmod(F.xxhash64(F.get("chunk_ids", F.lit(0))), F.lit(SPREAD)).cast("int")
    spread = terms.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return spread.join(blocks.withColumn("_part", part), ["term", "_part"]).drop("_part")


def best_of_chunks(asked: DataFrame, forward: DataFrame, avgdl: Column, k: int, pad_zero: bool, as_one: bool) -> DataFrame:
    """``query_id, chunk_id, score`` (rounded): the best ``k`` of each query in each task, which the best of all are among.

    ``asked`` holds ``query_id, term, weight``, with a null term for a query without any known one.
    A task holds a shard of the queries, and chunks pass by with all their terms, in the order of their
    ids: a chunk's score is whole in its own row, so no postings are shuffled and no row is made for a
    chunk and query. With ``pad_zero`` a chunk without any term of a query scores 0, else it is left out.
    ``as_one``: rows of one chunk id are one chunk, whose scores add up.
    """
    queries, chunks = asked.select(F.count_distinct("query_id")).first()[0], forward.count()
    shards = max(1, -(-queries // SHARD_QUERIES))
    tasks = min(TASKS_A_CORE * asked.sparkSession.sparkContext.defaultParallelism, max(1, chunks // TASK_CHUNKS))
    splits = max(1, -(-tasks // shards))
    rows = forward.where("chunk_id is not null").select("chunk_id", "length", "terms")
    shard, split = F.pmod(F.xxhash64("query_id"), F.lit(shards)), F.pmod(F.xxhash64("chunk_id"), F.lit(splits))
    met = meet(asked.select("query_id", "term", "weight", avgdl.alias("_avgdl")), rows, shard, shards, split, splits, "chunk_id")
    schema = T.StructType(
        [T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", forward.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, search, left = [], None, None
        for side, batch in sides(batches):
            if side == 0:
                held.append(batch)
                continue
            if search is None:
                if not held:
                    return
                search = _Search(pa.Table.from_batches(held), k, pad_zero)
            if as_one:
                if left is not None:
                    batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
                ids = batch["chunk_id"].to_numpy(zero_copy_only=False)
                last = int(np.argmax(ids == ids[-1]))
                batch, left = batch.slice(0, last), batch.slice(last)
            search.add(batch, as_one)
        if left is not None:
            search.add(left, True)
        if search is not None:
            yield from search.best.batches(search.ids, search.id_type)

    return met.select("_side", "query_id", "term", "weight", "_avgdl", "chunk_id", "length", "terms").mapInArrow(best, schema)


class _Search:
    """The queries of a task by term, and their best chunks so far."""

    def __init__(self, asked: pa.Table, k: int, pad_zero: bool):
        named = asked["query_id"].combine_chunks().dictionary_encode()
        self.ids, query = named.dictionary, named.indices.to_numpy()
        known = asked["term"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        terms = asked["term"].combine_chunks().filter(pa.array(known)).dictionary_encode()
        term = terms.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.vocabulary = terms.dictionary
        self.query, self.weight = query[known][order], asked["weight"].to_numpy()[known][order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.avgdl = asked["_avgdl"][0].as_py()
        self.best, self.pad_zero, self.started, self.id_type = Best(len(self.ids), k, in_order=True), pad_zero, False, None

    def add(self, chunks: pa.RecordBatch, as_one: bool) -> None:
        if not len(chunks):
            return
        ids, self.id_type = chunks["chunk_id"].to_numpy(zero_copy_only=False), chunks.schema.field("chunk_id").type
        place = np.arange(len(ids))
        if as_one:
            new = np.append(True, ids[1:] != ids[:-1])
            place, ids = np.cumsum(new) - 1, ids[new]
        copies = np.bincount(place)
        term, tf = chunks["terms"].flatten().flatten()
        row = np.repeat(np.arange(len(chunks)), pc.fill_null(pc.list_value_length(chunks["terms"]), 0).to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(term, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(term >= 0)
        term, row, tf = term[some], row[some], tf.to_numpy(zero_copy_only=False)[some].astype(np.float64)
        length = chunks["length"].to_numpy(zero_copy_only=False)[row]
        gain = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / self.avgdl)) if len(some) else tf
        place, step = place[row], max(1, CELLS // len(self.ids))
        for low in range(0, len(ids), step):
            a, b = np.searchsorted(place, [low, low + step])
            self._add(ids[low:low + step], copies[low:low + step], place[a:b] - low, term[a:b], gain[a:b])

    def _add(self, ids: np.ndarray, copies: np.ndarray, place: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
        n, width = len(ids), len(self.ids)
        times = self.first[term + 1] - self.first[term]
        of = np.repeat(np.arange(len(term)), times)
        asked = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + self.first[term[of]]
        cell = place[of] * width + self.query[asked]
        scores = np.bincount(cell, self.weight[asked] * gain[of], n * width).astype(np.float64).reshape(n, width)
        shared = None
        if not self.pad_zero or copies.max() > 1:
            shared = (np.bincount(cell, minlength=n * width) > 0).reshape(n, width)
            if not self.pad_zero:
                scores[~shared] = -np.inf
        k, limit = self.best.k, self.best.limit
        if not self.started and n >= k:
            np.maximum(limit, np.partition(scores, n - k, axis=0)[n - k] - 2 * ROUNDING, out=limit)
        hits = np.flatnonzero((scores >= limit) & (scores > -np.inf))
        r, q = np.divmod(hits, width)
        if shared is not None and self.pad_zero:
            times = np.where(shared[r, q], 1, copies[r])  # each copy of a chunk without a term fills a place
            r, q, hits = np.repeat(r, times), np.repeat(q, times), np.repeat(hits, times)
        if len(hits):
            self.best.add(q, np.floor(scores.ravel()[hits] * 1e6 + 0.5) / 1e6, ids[r])
        if not self.started:
            self.best.settle()
            self.started = True
