"""BM25 index, pair scoring and exact top-k as joins over a postings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import BM25_B, BM25_EPSILON, BM25_K1, BM25_TOP_K
from vulnlake.functions.text import tokens
from vulnlake.operators.postings import best_of_chunks, counted_terms
from vulnlake.operators.ranking import top_k
from vulnlake.session import stage


@dataclass(frozen=True)
class Index:
    """BM25 index as tables.

    ``postings(term, chunk_id, tf, length, gain)``: one row per term of a chunk; ``gain``
    is the saturated term frequency, so ``idf * gain`` is what one query occurrence adds.
    ``terms(term, df, idf, top_gain)``; ``doc_stats(chunk_id, length)``;
    ``corpus_stats(n, avgdl, avg_idf)``, one row. ``forward(chunk_id, length, terms)`` is what
    ``bm25_topk`` reads (see ``postings``); a stored index has ``blocks`` too.
    """

    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame
    blocks: DataFrame | None = None
    forward: DataFrame | None = None


def build_bm25(
    chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "content", durable: bool = True
) -> Index:
    """Index of ``chunks``.

    idf is ``ln(n - df + 0.5) - ln(df + 0.5)``; a negative one becomes a quarter of the
    mean idf over all terms. ``durable`` stages postings and terms, since every later
    step reads them several times.
    """
    words = chunks.select(
        F.col(chunk_id).alias("chunk_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words")
    )
    forward = counted_terms(words)
    if durable:
        forward = stage(forward, "bm25-forward")
    doc_stats = forward.select("chunk_id", "length")
    counted = forward.select("chunk_id", "length", F.inline("terms"))
    sizes = forward.agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("avgdl", F.try_divide(counted.agg(F.sum("tf")).scalar(), "n"))
    if durable:
        sizes = stage(sizes, "bm25-corpus")
    n, avgdl = sizes.select("n").scalar(), sizes.select("avgdl").scalar()
    damping = F.lit(BM25_K1) * (1 - BM25_B + BM25_B * F.try_divide("length", avgdl))
    postings = counted.select(
        "term", "chunk_id", "tf", "length",
        (F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + damping)).alias("gain"),
    )
    raw = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("top_gain"))
    raw = raw.withColumn("_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    avg_idf = raw.agg(F.avg("_idf")).scalar()
    idf = F.when(F.col("_idf") < 0, F.lit(BM25_EPSILON) * avg_idf).otherwise(F.col("_idf"))
    terms = raw.select("term", "df", idf.alias("idf"), "top_gain")
    if durable:
        terms = stage(terms, "bm25-terms")
    corpus_stats = sizes.withColumn("avg_idf", avg_idf)
    return Index(postings, terms, doc_stats, corpus_stats, forward=forward)


def query_terms(queries: DataFrame, index: Index, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Known query terms with ``df``, weight (occurrences times idf) and best possible part."""
    counted = (
        queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    weight = F.col("qtf") * F.col("idf")
    return counted.join(index.terms, "term").select(
        "query_id", "term", "df", weight.alias("weight"),
        F.greatest(weight * F.col("top_gain"), F.lit(0.0)).alias("best"),
    )


def bm25_score(pairs: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """BM25 score of given (``query_id``, ``chunk_id``) pairs; 0 without common term.

    Each pair looks up its own query terms by (chunk, term), a key without hot values;
    the product of all queries with all chunks of a frequent term never arises.
    """
    wanted = pairs.select("query_id", "chunk_id").distinct()
    terms = query_terms(queries, index).select("query_id", "term", "weight")
    looked_up = wanted.join(terms, "query_id", "left").join(
        index.postings.select("chunk_id", "term", "gain"), ["chunk_id", "term"], "left"
    )
    return looked_up.groupBy("query_id", "chunk_id").agg(
        F.round(F.coalesce(F.sum(F.col("weight") * F.col("gain")), F.lit(0.0)), 6).alias("score")
    )


def bm25_topk(
    queries: DataFrame,
    index: Index,
    k: int = BM25_TOP_K,
    pad_zero: bool = True,
    seed_postings: int | None = None,
    light_share: float | None = None,
) -> DataFrame:
    """K3: exact ``k`` best chunks per query -> ``query_id, chunk_id, score, rank``.

    Scores are rounded to six decimals; ties go to the smaller chunk id. A chunk's terms lie in one
    row of the index, so its scores need no shuffle of postings: bounded numbers of queries meet the
    rows in tasks that keep ``k`` chunks a query (see ``best_of_chunks``).

    ``pad_zero`` fills up with zero-score chunks, smallest id first, when a query has
    fewer than ``k`` scoring chunks. Queries of equal texts are searched once. ``seed_postings`` and
    ``light_share`` bounded an earlier search by postings and change nothing now.
    """
    texts = queries.where("query_id is not null").groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("_texts"))
    leads = texts.groupBy("_texts").agg(F.min("query_id").alias("_lead"))
    of_each = stage(texts.join(leads, "_texts").select("query_id", "_lead", "_texts"), "bm25-leads")
    asked = of_each.where("query_id = _lead").select("query_id", F.explode_outer("_texts").alias("text"))
    best = _searched(asked, index, k, pad_zero).withColumnRenamed("query_id", "_lead")
    return of_each.join(best, "_lead").select("query_id", *[c for c in best.columns if c != "_lead"])


def _searched(queries: DataFrame, index: Index, k: int, pad_zero: bool) -> DataFrame:
    terms = query_terms(queries, index).select("query_id", "term", "weight")
    asked = stage(queries.select("query_id").distinct().join(terms, "query_id", "left"), "bm25-query-terms")
    avgdl = index.corpus_stats.select("avgdl").scalar()
    best = best_of_chunks(asked, index.forward, avgdl, k, pad_zero, as_one=index.blocks is None)
    return top_k(best, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)
