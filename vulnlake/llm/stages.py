"""Stages of a corpus pipeline: documents in, documents (at the end pieces) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.llm import langid, minhash, packing, quality, secret_scan
from vulnlake.llm.common import free_name

LEAST_LANGUAGE = 0.3


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose quality score reaches the cut; all where there are no labels of both kinds."""
    model = quality.train(docs, labels)
    return docs.where(quality.quality_score(model, F.col("text")) >= quality.CUT)


def known_language(docs: DataFrame, least: float = LEAST_LANGUAGE) -> DataFrame:
    """Documents with a letter whose best language has a share of at least ``least``.

    Without any labelled text there is no language to know, and all documents stay.
    """
    net = langid.train(docs)
    return docs if net is None else docs.where(langid.language(net, F.col("text"))["score"] >= least)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group (the smallest id), and one row of each id.

    Rows without an id stay. Of rows repeating an id the one with the smallest text hash stays.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    number = free_name(docs, "number")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    left = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").withColumn(number, F.row_number().over(order))
    return left.where(F.col(number) == 1).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def without_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every found secret replaced."""
    return secret_scan.redact(docs)


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs, tokenizer))
