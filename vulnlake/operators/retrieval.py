"""Hybrid retrieval: supplement, de-duplicate, rerank, assemble the context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.domain import MIN_DOCS_BEFORE_BM25, RERANK_BATCH, RERANK_TOP_K
from vulnlake.functions.text import tokens
from vulnlake.operators.ranking import top_k


def needs_bm25(queries: DataFrame, vector: DataFrame, min_docs: int = MIN_DOCS_BEFORE_BM25) -> DataFrame:
    """Queries with fewer than ``min_docs`` vector rows; only these run BM25."""
    found = vector.groupBy("query_id").agg(F.count("*").alias("_n"))
    return (
        queries.join(found, "query_id", "left")
        .where(F.coalesce("_n", F.lit(0)) < min_docs)
        .drop("_n")
    )


def distinct_content(ranked: DataFrame) -> DataFrame:
    """U4: one row per query and content, the best-ranked one."""
    window = W.partitionBy("query_id", "content").orderBy("rank", "chunk_id")
    return ranked.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") == 1).drop("_nth")


def hybrid_dedupe(vector: DataFrame, bm25: DataFrame) -> DataFrame:
    """BM25 rows whose content the query's vector rows do not hold, nor an earlier
    BM25 row. A query has a handful of rows on each side."""
    seen = vector.select("query_id", "content").distinct()
    return distinct_content(bm25).join(seen, ["query_id", "content"], "left_anti").select(*bm25.columns)


def union_retrieved(
    vector: DataFrame, bm25: DataFrame, min_docs: int = MIN_DOCS_BEFORE_BM25
) -> DataFrame:
    """Vector rows first, then the new BM25 rows of queries with too few of them.

    Both frames hold ``query_id, chunk_id, content, rank``; ranks are renumbered.
    """
    counts = vector.groupBy("query_id").agg(F.count("*").alias("_n"))
    extra = (
        hybrid_dedupe(vector, bm25)
        .join(counts, "query_id", "left")
        .where(F.coalesce("_n", F.lit(0)) < min_docs)
        .drop("_n")
    )
    columns = ["query_id", "chunk_id", "content", "rank"]
    both = vector.select(*columns, F.lit("vector").alias("found_by")).unionByName(
        extra.select(*columns, F.lit("bm25").alias("found_by"))
    )
    order = W.partitionBy("query_id").orderBy(F.desc("found_by"), "rank", "chunk_id")
    return both.withColumn("rank", F.row_number().over(order))


def token_overlap(query: Column, content: Column) -> Column:
    """T3, built in: Jaccard similarity of the two token sets."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(content))
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


def pair_scorer(
    load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = RERANK_BATCH
) -> Callable[[Column, Column], Column]:
    """T3 hook: a user's model as a scorer column.

    ``load`` runs once per Python worker and returns a function from (query, content)
    pairs to scores, which is then called on ``batch`` pairs at a time.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, contents in batches:
            pairs = list(zip(queries, contents))
            out: list[float] = []
            for start in range(0, len(pairs), batch):
                out.extend(float(x) for x in model(pairs[start:start + batch]))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, T.DoubleType())


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    k: int = RERANK_TOP_K,
) -> DataFrame:
    """K4: keep the ``k`` candidates with the best (query, content) score per query.

    Reads ``query_id, query, chunk_id, content``. A query with a single candidate keeps
    it whatever its score; a query without any has no row. Adds ``score`` (rounded to
    six decimals) and renumbers ``rank``; ties go to the smaller chunk id.
    """
    scored = candidates.drop("score", "rank").withColumn(
        "score", F.round(scorer(F.col("query"), F.col("content")), 6)
    )
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def assemble_context(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Contents joined by a blank line in rank order; empty text without rows.

    ``ranked`` is a bounded top-k, so the list per query is short.
    """
    joined = ranked.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))),
                lambda r: r["content"],
            ),
            "\n\n",
        ).alias("context")
    )
    return queries.join(joined, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
