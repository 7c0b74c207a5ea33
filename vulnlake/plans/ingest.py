"""From corpus documents to an indexed chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import CHUNK_OVERLAP, CHUNK_SIZE
from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators.corpus import chunk_recursive, needs_splitting, union_chunks
from vulnlake.session import stage


def ingest(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    index_prechunked: bool = True,
    embedder: Callable[[Column], Column] = embed_hashed,
) -> DataFrame:
    """Documents (from ``load_corpus``) -> chunk table with id and embedding.

    The result is a staged table: numbering rows and writing them once fixes their ids,
    needs no shuffle, and equal chunks stay separate rows. Store it with ``write_index``;
    ``build_bm25`` and ``index_stats`` read it.
    """
    ready, rest = needs_splitting(documents)
    fresh = chunk_recursive(rest, size, overlap)
    chunks = union_chunks(ready, fresh, index_prechunked)
    numbered = chunks.withColumn("chunk_id", F.monotonically_increasing_id())
    return stage(numbered.withColumn("embedding", embedder(F.col("content"))), "chunks")
