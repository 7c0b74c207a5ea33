"""The in-run cache against the walk one by one, and a whole run with it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators import replay as rp
from vulnlake.operators.replay import replay
from vulnlake.plans import remediate as rm
from vulnlake.plans.remediate import remediate
from vulnlake.session import stage

CACHE = "seq bigint, key string, embedding array<double>, result string"


def walk(vectors, entries, threshold, max_size):
    """(source, ...) of every vector: entries are (number, vector), oldest first."""
    held, out = [(n, np.asarray(v)) for n, v in entries][-max_size:], []
    for number, v in enumerate(vectors):
        v = None if v is None else np.asarray(v, float)
        if v is None or not v.any():
            out.append(number)
            continue
        cosine = lambda w: v @ w / np.sqrt((v @ v) * (w @ w))
        hit = next((n for n, w in held if w.any() and cosine(w) >= threshold), None)
        out.append(number if hit is None else hit)
        if hit is None:
            held = [*held, (number, v)][-max_size:]
    return out


@pytest.mark.parametrize("max_size,stretch,kinds", [(100, 16, 12), (3, 16, 8), (5, 7, 400), (4, 1000, 30), (2, 1, 6)])
def test_replay_equals_the_walk(spark, max_size, stretch, kinds):
    rng = random.Random(max_size * stretch)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(kinds)]
    count = 40 if stretch == 1 else 200
    vectors = [[x + rng.gauss(0, 0.15) for x in rng.choice(centres)] for _ in range(count)]
    vectors[5], vectors[17], vectors[30] = None, [0.0] * 4, vectors[2]
    entries = [(s, f"k{s}", [rng.gauss(0, 1) for _ in range(4)], f"r{s}") for s in (3, 5, 9)] + [(4, "z", [0.0] * 4, "zero")]
    asked = spark.createDataFrame([(10 * i, v, "x") for i, v in enumerate(vectors)], "query_id bigint, embedding array<double>, number_ string").repartition(5)
    got = {r.number: (r.query_id, r.source) for r in replay(asked, spark.createDataFrame(entries, CACHE), 0.95, max_size, stretch=stretch).collect()}
    kept = sorted(entries)[-max_size:]
    want = walk(vectors, [(i - len(kept), e[2]) for i, e in enumerate(kept) if any(e[2])], 0.95, max_size)
    assert [got[i] for i in range(count)] == [(10 * i, s) for i, s in enumerate(want)]
    assert any(s < 0 for s in want) or kinds > 10 or max_size < 4
    assert len({s for i, s in enumerate(want) if s != i}) > 0


def test_replay_of_nothing(spark):
    empty = spark.createDataFrame([], CACHE)
    none = spark.createDataFrame([], "query_id bigint, embedding array<double>")
    assert replay(none, empty).count() == 0
    zero = spark.createDataFrame([(1, [0.0]), (2, None)], "query_id bigint, embedding array<double>")
    assert sorted((r.query_id, r.source) for r in replay(zero, empty).collect()) == [(1, 0), (2, 1)]


def test_run_with_a_cache(spark):
    """Similar findings share the first one's answer; equal, similar and foreign entries of the cache answer too."""
    texts = ["alpha beta gamma delta"] * 3 + ["alpha beta gamma delta new"] + ["one two three four"] * 2 + ["entirely different words here"]
    findings = spark.createDataFrame(
        [(i, "sast", "T", "a.py", i, "high", t) for i, t in enumerate(texts)],
        "finding_id bigint, origin string, type string, file string, line int, severity string, snippet string",
    )
    chunks = spark.createDataFrame([(1, "some guide", "s", "guide")], "chunk_id bigint, content string, source string, doc_type string")
    chunks = chunks.withColumn("embedding", embed_hashed(F.col("content")))

    def generator(prompts):
        return prompts.select("finding_id", F.concat(F.lit('{"suggested_fix": "f'), F.col("finding_id").cast("string"), F.lit('"}')).alias("answer"))

    stored = spark.createDataFrame([(5, "T|one two three four", '{"suggested_fix": "bare"}')], "seq bigint, key string, result string")
    stored = stored.withColumn("embedding", embed_hashed(F.col("key")).cast("array<double>"))
    run = remediate(findings, chunks, generator, cache=stored, cache_threshold=0.75)
    got = {r.finding_id: (r.from_cache, r.parsed.suggested_fix) for r in run.attempted.collect()}
    assert got == {0: (False, "f0"), 1: (True, "f0"), 2: (True, "f0"), 3: (True, "f0"), 4: (True, "bare"), 5: (True, "bare"), 6: (False, "f6")}
    assert [r.key for r in run.cache.orderBy("seq").collect()] == ["T|one two three four", "T|" + texts[0], "T|" + texts[6]]
    again = remediate(findings, chunks, generator, cache=run.cache, cache_threshold=0.75)
    assert again.attempted.where("from_cache").count() == len(texts) and again.cache.count() == 3
    small = remediate(findings, chunks, generator, cache=stored, cache_threshold=0.75, cache_size=1)
    assert [r.key for r in small.cache.collect()] == ["T|" + texts[6]]


def test_long_columns_do_not_travel(spark, monkeypatch):
    """codes are stored once, leaders are ranked without vectors, and a vector's length is worked out once."""
    kept = {}

    def staged(df, label):
        kept.setdefault(label, []).append(df.columns)
        return stage(df, label)

    monkeypatch.setattr(rp, "stage", staged)
    monkeypatch.setattr(rm, "stage", staged)
    columns = "finding_id bigint, origin string, type string, snippet string, severity string, file string, line int"
    findings = spark.createDataFrame([(i, "sast", t, code, "high", "f", 1) for i, t, code in ((1, "T", "a b"), (2, "T", "a b"), (2, "U", "c d"))], columns)
    chunks = spark.createDataFrame([(1, "a guide", "s", "guide")], "chunk_id bigint, content string, source string, doc_type string")
    chunks = chunks.withColumn("embedding", embed_hashed(F.col("content")))
    answer = lambda p: p.select("finding_id", F.to_json(F.struct(F.col("prompt").alias("suggested_fix"))).alias("answer"))
    run = remediate(findings, chunks, answer, cache=spark.createDataFrame([], CACHE))
    assert all("U" in r.prompt_ or "T" in r.prompt_ for r in run.attempted.select(F.col("parsed.suggested_fix").alias("prompt_")).collect())
    assert [label for label, columns in kept.items() if any("code" in c for c in columns)] == ["findings"]
    assert not any("unit" in c for c in kept["ranked-leaders"])
    unit = rp._with_unit(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>"), "v").select("unit")
    assert [r.unit for r in unit.collect()] == [[0.6, 0.8]]
    assert "/ SQRT(" not in unit._jdf.queryExecution().optimizedPlan().toString().upper()
