"""Hybrid retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import domain
from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators.bm25 import Index, bm25_topk
from vulnlake.operators.retrieval import needs_bm25, rerank, token_overlap, union_retrieved
from vulnlake.operators.vectors import mmr, vector_topk
from vulnlake.session import stage
from vulnlake.sources.index import StoredIndex


def retrieve(
    queries: DataFrame,
    chunks: DataFrame | StoredIndex,
    index: Index | None = None,
    vector_k: int = domain.VECTOR_K,
    fetch_k: int = domain.VECTOR_FETCH_K,
    bm25_k: int = domain.BM25_TOP_K,
    lambda_: float = domain.MMR_LAMBDA,
    min_docs: int = domain.MIN_DOCS_BEFORE_BM25,
    use_reranking: bool = True,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    rerank_k: int = domain.RERANK_TOP_K,
    embedder: Callable[[Column], Column] = embed_hashed,
) -> DataFrame:
    """``query_id, text`` -> ranked ``query_id, chunk_id, content, rank``.

    Vector candidates, MMR, BM25 for queries with fewer than ``min_docs`` vector rows,
    then a reranker. ``chunks`` holds ``chunk_id, content, embedding``. Each step
    narrows the next; texts join only after the top-k. ``chunks`` may be an opened index: its
    chunks, postings and vectors are searched as they are stored, and belong together by its version.
    """
    vectors = None
    if isinstance(chunks, StoredIndex):
        if index is not None:
            raise ValueError("a stored index comes with its own postings")
        chunks, index, vectors = chunks.chunks, chunks.bm25, chunks.vectors
    asked = queries.select("query_id", "text", embedder(F.col("text")).alias("embedding"))
    near = vector_topk(asked, chunks, fetch_k, index=vectors)
    with_vectors = near.join(chunks.select("chunk_id", "embedding"), "chunk_id")
    contents = chunks.select("chunk_id", "content")
    chosen = stage(
        mmr(with_vectors, vector_k, lambda_).join(contents, "chunk_id").select("query_id", "chunk_id", "content", "rank"),
        "retrieved",
    )
    if index is None:
        found = chosen
    else:
        short = needs_bm25(queries.select("query_id", "text"), chosen, min_docs)
        words = bm25_topk(short, index, bm25_k).join(contents, "chunk_id")
        found = union_retrieved(chosen, words.select("query_id", "chunk_id", "content", "rank"), min_docs)
    if not use_reranking:
        return found.select("query_id", "chunk_id", "content", "rank")
    pairs = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rerank(pairs, scorer, rerank_k).select("query_id", "chunk_id", "content", "rank")
