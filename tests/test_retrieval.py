import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnlake.operators import bm25, postings as ps, retrieval as rt, vectors as vc
from vulnlake.operators.ranking import number_rows, top_k
from vulnlake.operators.streamed import Best
from vulnlake.plans.retrieve import retrieve
from vulnlake.session import stage


def brute_bm25(chunks, query):
    """Scores of all chunks, straight from the formula."""
    docs = {i: t.lower().split() for i, t in chunks}
    n = len(docs)
    avgdl = sum(map(len, docs.values())) / n
    df = Counter(t for words in docs.values() for t in set(words))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    out = {}
    for i, words in docs.items():
        tf = Counter(words)
        out[i] = sum(
            idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(words) / avgdl)) for q in query.lower().split()
        )
    return out


def ranked(scores, k):
    return sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]


@pytest.mark.parametrize("k,seed_postings", [(2, 500), (3, 1), (5, 20)])
def test_bm25_equals_brute_force(spark, k, seed_postings):
    rng = random.Random(k)
    words = ["the"] * 30 + ["of"] * 15 + [f"w{i}" for i in range(60)]
    chunks = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(150)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(25)]
    queries += [(25, "w1 w1 the"), (26, "unknown words"), (27, ""), (28, "the of")]
    index = bm25.build_bm25(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
    asked = spark.createDataFrame(queries, "query_id int, text string")
    rows = bm25.bm25_topk(asked, index, k, seed_postings=seed_postings).collect()
    for qid, text in queries:
        want = ranked(brute_bm25(chunks, text), k)
        got = sorted((r["rank"], r.chunk_id, r.score) for r in rows if r.query_id == qid)
        assert [(i, pytest.approx(s, abs=2e-6)) for _, i, s in got] == [(i, -s) for s, i in want], text


def test_bm25_small_corpora(spark):
    """All terms frequent: the mean idf, and with it the floor, can be negative."""
    chunks = [(1, "a b"), (2, "a b c"), (3, "a")]
    index = bm25.build_bm25(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
    rows = bm25.bm25_topk(spark.createDataFrame([(1, "a b")], "query_id int, text string"), index, 2).collect()
    want = ranked(brute_bm25(chunks, "a b"), 2)
    assert [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"])] == [i for _, i in want]


def test_bm25_without_padding_and_empty(spark):
    index = bm25.build_bm25(spark.createDataFrame([(1, "x y"), (2, "z")], "chunk_id bigint, content string"))
    asked = spark.createDataFrame([(1, "z"), (2, "q")], "query_id int, text string")
    assert [r.chunk_id for r in bm25.bm25_topk(asked, index, 2, pad_zero=False).collect()] == [2]
    empty = bm25.build_bm25(spark.createDataFrame([], "chunk_id bigint, content string"))
    assert bm25.bm25_topk(asked, empty).count() == 0


def vectors_frame(spark, matrix, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{key} bigint, embedding array<double>")


def brute_nearest(queries, chunks, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.floor(unit(queries) @ unit(chunks).T * 1e6 + 0.5) / 1e6
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return {q: list(map(int, order[q])) for q in range(len(queries))}


@pytest.mark.parametrize("skew", [False, True])
def test_vector_topk_equals_brute_force(spark, skew, monkeypatch):
    monkeypatch.setattr(vc, "SHARD_BLOCKS", 2)  # several shards even for small clusters
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    chunks = centres[rng.integers(12, size=900)] + 0.3 * rng.normal(size=(900, 8))
    if skew:
        chunks[:400] = centres[0] + 1e-3 * rng.normal(size=(400, 8))
        chunks[400:450] = chunks[0]
    queries = np.vstack([chunks[::30], rng.normal(size=(10, 8))])
    rows = vc.vector_topk(vectors_frame(spark, queries, "query_id"), vectors_frame(spark, chunks, "chunk_id"), 7, block_rows=64).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == brute_nearest(queries, chunks, 7)


def test_queries_are_not_copied_to_clusters(spark, monkeypatch):
    """Where no cluster is ruled out: no stored table has a row per query and cluster, whatever the shards and splits."""
    rng = np.random.default_rng(5)
    chunks = rng.normal(size=(900, 24))
    asked, given, staged = vectors_frame(spark, chunks, "query_id"), vectors_frame(spark, chunks, "chunk_id"), []

    def counted(df, label):
        out = stage(df, label)
        staged.append(out.count())
        return out

    monkeypatch.setattr(vc, "stage", counted)
    monkeypatch.setattr(vc, "PIVOT_SHARE", 1)
    want = brute_nearest(chunks, chunks, 3)
    for pairs, held in ((1 << 28, 32 << 20), (20_000, 100_000)):
        monkeypatch.setattr(vc, "TASK_PAIRS", pairs, raising=False)
        monkeypatch.setattr(vc, "HELD_BYTES", held, raising=False)
        got = {}
        for r in sorted(vc.vector_topk(asked, given, 3).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want
    assert max(staged) <= 3 * 900


def test_best_of_streamed_candidates():
    rng = np.random.default_rng(6)
    best = Best(5, 2)
    best._room = 7  # cut again and again
    seen = []
    for _ in range(40):
        q, s, i = rng.integers(4, size=9), rng.integers(6, size=9) / 4, rng.integers(100, size=9)
        reached = s >= best.limit[q]
        best.add(q[reached], s[reached], i[reached])
        best._room = 7
        seen += zip(q, s, i)
    got = [r for b in best.batches(pa.array([f"q{n}" for n in range(5)]), pa.int64()) for r in b.to_pylist()]
    want = [(f"q{n}", i, s) for n in range(4) for s, i in sorted(((s, i) for q, s, i in seen if q == n), key=lambda x: (-x[0], x[1]))[:2]]
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == want
    named = Best(1, 2)
    named.add(np.zeros(3, int), np.ones(3), np.array(["b", "c", "a"], object))
    assert [b["chunk_id"].to_pylist() for b in named.batches(pa.array([1]), pa.string())] == [["a", "b"]]
    assert list(Best(3, 2).batches(pa.array([1, 2, 3]), pa.int64())) == []


def test_vector_edge_cases(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "chunk_id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "query_id bigint, embedding array<double>")
    rows = vc.vector_topk(queries, chunks, 5).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in rows] == [(1, 1, 1)]
    assert vc.vector_topk(queries, chunks.limit(0), 5).count() == 0
    assert vc.vector_topk(queries.limit(0), chunks, 5).count() == 0


def test_approximate_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 16))
    chunks = centres[rng.integers(10, size=1000)] + 0.2 * rng.normal(size=(1000, 16))
    queries = chunks[::20] + 0.05 * rng.normal(size=(50, 16))
    rows = vc.vector_topk(vectors_frame(spark, queries, "query_id"), vectors_frame(spark, chunks, "chunk_id"), 5, probes=3).collect()
    want = brute_nearest(queries, chunks, 5)
    assert sum(r.chunk_id in want[r.query_id] for r in rows) / 250 >= 0.9


def candidates(spark):
    rows = [
        (1, 10, 0.9, 1, [1.0, 0.0]), (1, 11, 0.89, 2, [1.0, 0.01]), (1, 12, 0.5, 3, [0.0, 1.0]), (2, 10, 0.4, 1, [1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int, embedding array<double>")


def test_mmr(spark):
    pick = lambda lam: [
        r.chunk_id for r in sorted(vc.mmr(candidates(spark), 3, lam).where("query_id = 1").collect(), key=lambda r: r["rank"])
    ]
    assert pick(1.0) == [10, 11, 12]
    assert pick(0.5) == [10, 12, 11]
    assert vc.mmr(candidates(spark), 3).where("query_id = 2").count() == 1
    assert vc.mmr(candidates(spark).limit(0)).count() == 0


def test_top_k(spark):
    rows = spark.createDataFrame([("a", 1, 0.8), ("a", 2, 0.8), ("a", 3, 0.9), ("b", 4, 0.0)], "q string, id int, s double")
    best = top_k(rows, ["q"], [F.desc("s"), F.col("id")], 2)
    assert {(r.q, r.id, r["rank"]) for r in best.collect()} == {("a", 3, 1), ("a", 1, 2), ("b", 4, 1)}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("by", [["k"], []])
def test_number_rows_spreads_hot_keys(spark, by):
    rows = [("hot" if i % 3 else f"k{i}", i * 7 % 1000) for i in range(1000)] + [(None, 2000), (None, 2001)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = number_rows(df, by, [F.desc("v")], "n").collect()
    want = Counter()
    for r in sorted(got, key=lambda r: -r.v):
        key = r.k if by else "all"
        want[key] += 1
        assert r.n == want[key]
    assert len(got) == len(rows)


def test_hybrid(spark):
    vector = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "y", 2), (2, 1, "x", 1), (2, 2, "y", 2), (2, 3, "z", 3), (2, 4, "w", 4)], "query_id int, chunk_id int, content string, rank int")
    words = spark.createDataFrame([(1, 9, "y", 1), (1, 8, "n", 2), (1, 7, "n", 3), (2, 9, "q", 1), (3, 5, "only", 1)], "query_id int, chunk_id int, content string, rank int")
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in rt.union_retrieved(vector, words, 4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (1, 8, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 4), (3, 5, 1)]
    short = rt.needs_bm25(spark.createDataFrame([(1,), (2,), (3,)], "query_id int"), vector, 4)
    assert sorted(r.query_id for r in short.collect()) == [1, 3]


def test_rerank(spark):
    pairs = spark.createDataFrame(
        [(1, "a b", 1, "a b"), (1, "a b", 2, "a"), (1, "a b", 3, "c"), (2, "q", 4, "none")], "query_id int, query string, chunk_id int, content string"
    )
    got = [(r.query_id, r.chunk_id, r.score) for r in rt.rerank(pairs).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 2, 0.5), (2, 4, 0.0)]

    def load():
        return lambda batch: [float(len(content)) if len(batch) <= 8 else -1.0 for _, content in batch]

    custom = rt.rerank(pairs, rt.pair_scorer(load), 1)
    assert sorted((r.query_id, r.chunk_id) for r in custom.collect()) == [(1, 1), (2, 4)]
    assert rt.rerank(pairs.limit(0)).count() == 0


def test_context(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = spark.createDataFrame([(1, 5, "b", 2), (1, 6, "a", 1)], "query_id int, chunk_id int, content string, rank int")
    got = {r.query_id: r.context for r in rt.assemble_context(queries, rows).collect()}
    assert got == {1: "a\n\nb", 2: ""}


def test_retrieve(spark):
    from vulnlake.functions.vectors import embed_hashed

    texts = ["sql injection fix", "xss escape html", "use parameterised sql", "pickle is unsafe", "yaml load unsafe", "shell injection"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, content string").withColumn("embedding", embed_hashed(F.col("content")))
    queries = spark.createDataFrame([(1, "sql injection"), (2, "unsafe")], "query_id int, text string")
    index = bm25.build_bm25(chunks)
    rows = retrieve(queries, chunks, index, vector_k=2, min_docs=4).collect()
    first = {r.query_id: r.content for r in rows if r["rank"] == 1}
    assert first[1] == "sql injection fix" and "unsafe" in first[2]
    assert all(2 <= sum(r.query_id == q for r in rows) <= 4 for q in (1, 2))
    assert retrieve(queries, chunks, None, vector_k=2).count() == 4
    assert retrieve(queries, chunks, index, use_reranking=True).count() == 4


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Queries of equal texts have the same results, of one search; a repeated id counts its words again."""
    searched = []
    inner = bm25._searched

    def counted(queries, *args):
        searched.append(queries.select("query_id").distinct().count())
        return inner(queries, *args)

    monkeypatch.setattr(bm25, "_searched", counted)
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b c", "z", "q r", "s"])], "chunk_id bigint, content string")
    rows = [(i, ["r q", "zz", None][i % 3]) for i in range(30)] + [(40, "s"), (41, "s"), (41, "s"), (None, "s")]
    queries = spark.createDataFrame(rows, "query_id bigint, text string")
    found = bm25.bm25_topk(queries, bm25.build_bm25(chunks)).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score, r.rank))
    assert searched == [5] and len(got) == 32
    assert all(got[i] == got[i % 3] for i in range(30))
    assert [c for c, _, _ in got[0]] == [3, 0] and [c for c, _, _ in got[1]] == [0, 1]
    assert got[41][0][0] == got[40][0][0] == 4 and got[41][0][1] == pytest.approx(2 * got[40][0][1], abs=2e-6)


@pytest.mark.parametrize("pad_zero", [True, False])
def test_bm25_makes_no_row_per_chunk_and_query(spark, monkeypatch, pad_zero):
    """Where all chunks share a term with all queries, results of many small tasks are those of brute force, and few rows are stored."""
    rng, staged = random.Random(8), []
    words = ["the"] * 20 + ["of"] * 10 + [f"w{i}" for i in range(40)]
    chunks = [(i, "the " + " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(400)] + [(400, ""), (401, None), (402, "alone")]
    queries = [(i, "the of " + " ".join(rng.choices(words, k=5))) for i in range(40)] + [(40, "unknown"), (41, "alone")]
    index = bm25.build_bm25(spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(3))

    def counted(df, label):
        out = stage(df, label)
        staged.append(out.count())
        return out

    monkeypatch.setattr(bm25, "stage", counted)
    monkeypatch.setattr(ps, "stage", counted, raising=False)
    for name, value in (("SHARD_QUERIES", 15), ("TASK_CHUNKS", 100), ("CELLS", 64)):
        monkeypatch.setattr(ps, name, value, raising=False)
    rows = bm25.bm25_topk(spark.createDataFrame(queries, "query_id bigint, text string"), index, 3, pad_zero).collect()
    held = [(i, t or "") for i, t in chunks]
    for qid, text in queries:
        want = ranked(brute_bm25(held, text), 3)
        if not pad_zero:
            shared = {i for i, t in held if set(t.split()) & set(text.split())}
            want = [(s, i) for s, i in ranked(brute_bm25(held, text), len(held)) if i in shared][:3]
        got = sorted((r["rank"], r.chunk_id, r.score) for r in rows if r.query_id == qid)
        assert [(i, pytest.approx(s, abs=2e-6)) for _, i, s in got] == [(i, -s) for s, i in want], text
    assert max(staged) <= 10 * len(queries)


def test_rows_of_one_chunk_add_up(spark, monkeypatch):
    """An index in memory takes rows of one id as one chunk, whose scores add up, also where a task's batches cut between them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        chunks = [(1, "a"), (1, "a"), (1, "a"), (2, "a a"), (3, "b"), (3, "c"), (5, "d"), (6, "d"), (7, "d"), (8, "d")]
        index = bm25.build_bm25(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
        asked = spark.createDataFrame([(1, "a"), (2, "c b"), (3, "zz")], "query_id int, text string")
        single = {r.chunk_id: r.score for r in bm25.bm25_topk(asked.where("query_id = 1"), bm25.build_bm25(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(chunks)], "chunk_id bigint, content string")), 4).collect()}
        got = {}
        for r in sorted(bm25.bm25_topk(asked, index, 2).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert got[1][0] == (1, pytest.approx(3 * single[0], abs=3e-6)) and got[1][1] == (2, pytest.approx(single[3], abs=2e-6))
        assert got[2][0][0] == 3 and got[2][1] == (1, 0.0) and [c for c, _ in got[3]] == [1, 1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
