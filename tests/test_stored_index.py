"""The stored index against one in memory, its versions, and what a search of it reads."""

import random

import pytest
from pyspark.sql import functions as F

from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators import bm25, postings as ps, vectors as vc
from vulnlake.plans.retrieve import retrieve
from vulnlake.sources import index


def chunk_rows(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id bigint, content string").withColumn("doc_type", F.when(F.col("chunk_id") % 3 > 0, "guide"))
    return df.withColumn("embedding", embed_hashed(F.col("content")))


def texts(rng, count, first=0):
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(first + i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 12, 40])))) for i in range(count)]


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("stored") / "index")
    first, more = texts(rng, 500), texts(rng, 300, 1000)
    index.write_index(chunk_rows(spark, first), path)
    one = index.open_index(spark, path)
    index.append_index(chunk_rows(spark, more), path)
    asked = spark.createDataFrame(texts(rng, 25) + [(900, "w0 w1"), (901, "nothing known"), (902, None), (903, "w59 w0 w0")], "query_id bigint, text string")
    return path, first, more, one, index.open_index(spark, path), asked


@pytest.mark.parametrize("k,seed_postings,block", [(2, 500, 128), (5, 5, 4), (1, 1, 2)])
def test_top_k_equals_the_index_in_memory(spark, stored, tmp_path, monkeypatch, k, seed_postings, block):
    _, first, more, _, both, asked = stored
    chunks = chunk_rows(spark, first + more)
    if block != 128:
        monkeypatch.setattr(ps, "BLOCK", block)
        index.write_index(chunks, str(tmp_path / "small"))
        both = index.open_index(spark, str(tmp_path / "small"))
    want = ranked(bm25.bm25_topk(asked, bm25.build_bm25(chunks), k, seed_postings=seed_postings))
    assert ranked(bm25.bm25_topk(asked, both.bm25, k, seed_postings=seed_postings)) == want and len(want) == 29 * k


def test_statistics_of_parts_add_up(spark, stored):
    _, first, more, one, both, _ = stored
    whole = bm25.build_bm25(chunk_rows(spark, first + more))
    key = lambda df: sorted((r.term, r.df, round(r.idf, 9), round(r.top_gain, 9) >= 0) for r in df.collect())
    assert key(both.bm25.terms) == key(whole.terms)
    assert both.bm25.corpus_stats.first().asDict() == pytest.approx(whole.corpus_stats.first().asDict())
    assert both.bm25.postings.count() == whole.postings.count() and one.version == 1 and both.version == 2
    assert both.chunks.count() == 800 and one.chunks.count() == 500
    best = both.bm25.postings.groupBy("term").agg(F.max("gain").alias("g")).join(both.bm25.terms, "term")
    assert best.where("g > top_gain + 1e-12").isEmpty()


def test_vectors_equal_a_search_without_index(spark, stored):
    _, first, more, _, both, asked = stored
    queries = asked.withColumn("embedding", embed_hashed(F.col("text")))
    chunks = chunk_rows(spark, first + more)
    assert ranked(vc.vector_topk(queries, k=7, index=both.vectors)) == ranked(vc.vector_topk(queries, chunks, 7))


def test_retrieval_from_a_stored_index(spark, stored):
    _, first, more, _, both, asked = stored
    chunks = chunk_rows(spark, first + more)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    assert rows(retrieve(asked, both, min_docs=6)) == rows(retrieve(asked, chunks, bm25.build_bm25(chunks), min_docs=6))
    with pytest.raises(ValueError):
        retrieve(asked, both, both.bm25)


def test_query_terms_reach_the_scan(spark, stored):
    terms = spark.createDataFrame([(1, "w3"), (2, "w9")], "query_id bigint, term string")
    plan = ps.blocks_of(terms, stored[4].bm25.blocks)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [w3,w9])" in plan or "In(term, [w9,w3])" in plan


def test_versions(spark, stored):
    path, _, more, _, both, _ = stored
    with pytest.raises(ValueError):
        index.append_index(chunk_rows(spark, more), path)
    broken = chunk_rows(spark, texts(random.Random(1), 5, 5000)).withColumn("content", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        index.append_index(broken, path)
    again = index.open_index(spark, path)
    assert again.version == both.version and again.chunks.count() == 800
    index.write_index(chunk_rows(spark, more), path, rebuild=True)
    fresh = index.open_index(spark, path)
    assert fresh.version == 3 and fresh.chunks.count() == 300 and both.chunks.count() == 800


def test_empty_and_textless_indexes(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert index.open_index(spark, path) is None
    index.write_index(chunk_rows(spark, []), path)
    stored, words = index.load_index(spark, path)
    assert stored.count() == 0 and words is None and "content" in stored.columns
    index.append_index(chunk_rows(spark, [(1, ""), (2, None)]), path)
    opened = index.open_index(spark, path)
    asked = spark.createDataFrame([(1, "a b")], "query_id bigint, text string")
    assert opened.vectors is None and opened.bm25.terms.count() == 0
    assert [(r.chunk_id, r.score) for r in bm25.bm25_topk(asked, opened.bm25).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    index.append_index(chunk_rows(spark, [(3, "a c")]), path)
    assert bm25.bm25_topk(asked, index.open_index(spark, path).bm25, 1).first().chunk_id == 3
