import json

import pytest
from pyspark.sql import functions as F

from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators import cache as ca, remediation as rm
from vulnlake.operators.bm25 import build_bm25
from vulnlake.plans.remediate import remediate
from vulnlake.sources import sinks
from vulnlake.streaming.stream_cache import batch_cache, stream_cache

RESPONSES = [
    ('{"suggested_fix": "a\\nb", "confidence": "High"}', ("a\nb", None, "High", None)),
    ('```json\n{"suggested_fix": "use ``` here"}\n```', ("use ``` here", None, None, None)),
    ('text before ```json {"explanation": "e"} ```', (None, "e", None, None)),
    ('```\n{"cwe_id": "CWE-1"}\n```', (None, None, None, "CWE-1")),
    ('[{"explanation": "first"}, {"explanation": "second"}]', (None, "first", None, None)),
    ("{'suggested_fix': 'q', explanation: 'z',}", ("q", "z", None, None)),
    ('{"suggested_fix": "cut off', ("cut off", None, None, None)),
    ("not json", None), ("", None), (None, None), ("[]", None), ("[1]", None), ("{}", None), ("42", None),
]


def test_parse_response(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(RESPONSES)], "i int, a string")
    got = {r.i: r.p for r in rows.select("i", rm.parse_response(F.col("a")).alias("p")).collect()}
    for i, (_, want) in enumerate(RESPONSES):
        assert (None if got[i] is None else tuple(got[i])) == want, RESPONSES[i]


def test_escapes_are_undone_once_and_any_object_counts(spark):
    broken = '{suggested_fix: "C:\\\\new \\u00e9\\/", broken "explanation": "a\\\\"}'
    rows = spark.createDataFrame([(1, broken), (2, '{"foo": 1}'), (3, "{}"), (4, "[{\"foo\": 1}]")], "i int, a string")
    got = {r.i: r.p for r in rows.select("i", rm.parse_response(F.col("a")).alias("p")).collect()}
    assert got[1].suggested_fix == "C:\\new é/"
    assert got[2] is not None and got[2].suggested_fix is None and got[3] is None and got[4] is not None


def test_query_and_prompt(spark):
    rows = spark.createDataFrame([("XSS", "B701", None, "CWE-79"), (None, None, "", None)], "t string, b string, d string, c string")
    got = [r.q for r in rows.select(rm.retrieval_query(*[F.col(c) for c in "tbdc"]).alias("q")).collect()]
    assert got == ["XSS B701 CWE-79 vulnerability security fix", "Unknown vulnerability security fix"]
    findings = spark.createDataFrame([("T", "a\\nb {context}"), (None, None)], "finding_type string, code string")
    prompts = [r.prompt for r in rm.render_prompt(findings, "{finding_type}/{severity}/{line_number}: {original_code}|{context}").collect()]
    assert prompts == ["T/Medium/Unknown: a\nb {context}|", "Unknown/Medium/Unknown: |"]
    assert "Guidance" in rm.render_prompt(findings).first().prompt


def test_cache_key(spark):
    rows = spark.createDataFrame([("T", "x" * 300), (None, None)], "t string, s string")
    assert [r.k for r in rows.select(ca.cache_key(F.col("t"), F.col("s")).alias("k")).collect()] == ["T|" + "x" * 200, "|"]


def cache(spark, *rows):
    return spark.createDataFrame([(s, f"k{s}", v, f"r{s}") for s, v in rows], "seq bigint, key string, embedding array<double>, result string")


def test_cache_lookup(spark):
    stored = cache(spark, (1, [0.0, 1.0]), (2, [1.0, 0.2]), (3, [1.0, 0.0]), (4, [0.0, 0.0]))
    keys = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [-1.0, 0.0]), ("d", None)], "id string, embedding array<double>")
    hits, misses = ca.cache_lookup(keys, stored, 0.95)
    assert [(r.id, r.hit_seq, r.result) for r in hits.collect()] == [("a", 2, "r2")], "first, not best"
    assert sorted(r.id for r in misses.collect()) == ["b", "c", "d"]
    hits, misses = ca.cache_lookup(keys, stored.limit(0), 0.95)
    assert hits.count() == 0 and misses.count() == 4


def test_cache_append_and_retain(spark):
    stored = cache(spark, (1, [1.0]), (2, [2.0]), (3, [3.0]))
    fresh = spark.createDataFrame(
        [(1, "k2", [9.0], "new"), (2, "x", [1.0], "x1"), (3, "y", [1.0], "y1"), (4, "x", [5.0], "x2")],
        "arrival bigint, key string, embedding array<double>, result string",
    )
    got = [(r.seq, r.key, r.result) for r in ca.cache_append(stored, fresh, 4).orderBy("seq").collect()]
    assert got == [(2, "k2", "new"), (3, "k3", "r3"), (4, "x", "x2"), (5, "y", "y1")]
    assert ca.cache_append(stored.limit(0), fresh, 2).count() == 2
    assert ca.cache_stats(stored).first().cache_size == 3
    per_key = stored.withColumn("t", F.col("seq") % 2)
    assert ca.fifo_retain(per_key, 1, ("t",)).count() == 2


def test_review(spark):
    rems = spark.createDataFrame([(i,) for i in range(1, 7)], "position int")
    choices = spark.createDataFrame(list(enumerate("ynYqyq", 1)), "position int, choice string")
    assert sorted(r.position for r in rm.apply_review(rems, choices).collect()) == [1, 3]
    assert rm.apply_review(rems, choices.where("choice <> 'q'")).count() == 3


def test_counts(spark):
    rows = spark.createDataFrame([("High", "High"), (None, None), ("odd", "Sure")], "severity string, confidence string")
    assert {r.severity: r.n for r in rm.count_by_severity(rows).collect()} == {"critical": 0, "high": 1, "medium": 1, "low": 0, "odd": 1}
    assert {r.confidence: r.n for r in rm.count_by_confidence(rows).collect()} == {"High": 1, "Medium": 1, "Low": 0, "Sure": 1}
    assert all(r.n == 0 for r in rm.count_by_severity(rows.limit(0)).collect())


def test_origin_counts_with_nulls(spark):
    schema = "origin string, finding struct<type: string, line: int>"
    rems = spark.createDataFrame([("sast", ("a", None)), ("sast", ("a", None)), ("cve", (None, 1)), ("cve", ("b", 2))], schema)
    sast = spark.createDataFrame([("sast", ("a", None)), ("sast", ("zz", 2))], schema)
    assert tuple(rm.origin_counts(rems, sast).first()) == (2, 2)
    assert tuple(rm.origin_counts_by_column(rems).first()) == (2, 2)
    assert tuple(rm.origin_counts(rems.limit(0), sast).first()) == (0, 0)


def test_generate(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom")], "finding_id int, prompt string")

    def load():
        def model(prompt):
            if prompt == "boom":
                raise RuntimeError("no answer")
            return prompt.upper()

        return model

    many = rm.generate(spark.range(400).select(F.col("id").alias("finding_id"), F.concat(F.lit("p"), "id").alias("prompt")), load, tasks=4)
    assert many.rdd.getNumPartitions() >= 1 and "REPARTITION_BY_NUM" in many._jdf.queryExecution().toString()
    got = {r.finding_id: (r.answer, r.error) for r in rm.generate(prompts, load).collect()}
    assert got == {1: ("A", None), 2: ("A", None), 3: (None, "no answer")}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "type string, seq bigint, embedding array<double>")


def test_batch_cache(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.1]), ("a", 3, [0.0, 1.0]), ("b", 4, [1.0, 0.0]), ("a", 5, [0.0, 0.0]), ("a", 6, [1.0, 0.0]), ("a", 7, None)]
    got = {r.seq: (r.hit, r.hit_seq) for r in batch_cache(vectors(spark, rows)).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 1), 7: (False, None)}
    small = {r.seq: r.hit_seq for r in batch_cache(vectors(spark, rows), max_size=1).collect()}
    assert small[6] is None, "evicted"
    leaders = batch_cache(vectors(spark, rows).where("seq < 5"), threshold=-1.0).where("not hit")
    assert sorted(r.seq for r in leaders.collect()) == [1, 4]


def test_stream_equals_batch(spark, tmp_path, request):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        vectors(spark, rng.sample(rows[part * 40:(part + 1) * 40], 40)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("type string, seq bigint, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(source)
    # arrival order within a trigger is not seq order, and batches are far smaller than a trigger
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    query = (
        stream_cache(stream, max_size=5).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.seq: (r.type, r.hit, r.hit_seq) for r in spark.read.parquet(out).collect()}
    want = {r.seq: (r.type, r.hit, r.hit_seq) for r in batch_cache(vectors(spark, rows), max_size=5).collect()}
    assert got == want and any(hit for _, hit, _ in got.values())


@pytest.fixture()
def knowledge(spark):
    texts = ["sql injection: use parameters", "xss: escape output", "secrets: use a vault", "upgrade vulnerable dependency"]
    rows = [(i, t, f"src{i}", "cwe") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, content string, source string, doc_type string")
    return chunks.withColumn("embedding", embed_hashed(F.col("content")))


def test_remediate(spark, knowledge, tmp_path):
    findings = spark.createDataFrame(
        [
            (1, "sast", "SQL Injection", "a.py", 3, "high", "q = 'x' + y", None, None, None),
            (2, "sast", "SQL Injection", "b.py", 9, "low", "q = 'x' + y", None, None, None),
            (3, "sast", "Bad Answer", "c.py", 1, "critical", "zzz", None, None, None),
            (4, "cve", None, "r.txt", None, None, None, "flask", "1.0", ["CVE-1"]),
        ],
        "finding_id bigint, origin string, type string, file string, line int, severity string, snippet string, package string, version string, cves array<string>",
    )

    def generator(prompts):
        answer = F.when(F.col("prompt").contains("Bad Answer"), "sorry").otherwise(
            '```json\n{"suggested_fix": "fixed", "explanation": "why", "confidence": "High", "cwe_id": "CWE-89"}\n```'
        )
        return prompts.select("finding_id", answer.alias("answer"))

    empty = spark.createDataFrame([], "seq bigint, key string, embedding array<double>, result string")
    run = remediate(findings, knowledge, generator, build_bm25(knowledge), cache=empty, vector_k=2, min_docs=4)
    summary = run.summary.first()
    assert (summary.total_findings, summary.successful_remediations, summary.failed_remediations) == (4, 3, 1)
    assert (summary.sast_findings_count, summary.cve_findings_count, summary.severity_high, summary.severity_medium) == (2, 1, 1, 1)
    records = {r.finding_id: r for r in run.remediations.collect()}
    assert set(records) == {1, 2, 4} and records[4].finding.package == "flask"
    assert all(r.suggested_fix == "fixed" and 2 <= len(r.source_documents) <= 4 for r in records.values())
    stored = run.cache.orderBy("seq").collect()
    assert [r.key.split("|")[0] for r in stored] == ["SQL Injection", "Bad Answer", "Vulnerable Dependency: flask"]
    again = remediate(findings, knowledge, generator, cache=run.cache, vector_k=2)
    assert again.attempted.where("from_cache").count() == 4
    sources = lambda r: {x.finding_id: x.source_documents for x in r.remediations.collect()}
    assert sources(again) == sources(run)
    high = remediate(findings, knowledge, generator, severity="high", vector_k=2)
    assert high.summary.first().total_findings == 2
    choices = spark.createDataFrame([(1, "n"), (2, "y"), (4, "q")], "position bigint, choice string")
    kept = remediate(findings, knowledge, generator, decisions=choices, vector_k=2)
    assert [r.finding_id for r in kept.remediations.collect()] == [2]
    sinks.write_remediations(run.remediations, run.summary, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out/remediations")).first().value)
    assert set(line) >= {"finding", "suggested_fix", "confidence", "source_documents"}


def test_equal_texts_are_searched_once(spark, monkeypatch):
    """Findings of other keys that ask the same text: one search, the same context and sources for each."""
    from vulnlake.plans import remediate as plan

    asked = []

    def counted(queries, *args, **kwargs):
        asked.append(queries.count())
        return retrieve(queries, *args, **kwargs)

    retrieve = plan.retrieve
    monkeypatch.setattr(plan, "retrieve", counted)
    chunks = spark.createDataFrame([(1, "sql injection security fix", "S1", "cwe"), (2, "other words", "S2", "cwe")], "chunk_id bigint, content string, source string, doc_type string")
    chunks = chunks.withColumn("embedding", embed_hashed(F.col("content")))
    rows = [(i, "SQL Injection", "f.py", i, "high", f"code {i}", "sast") for i in range(5)] + [(9, "XSS", "f.py", 9, "high", "code 9", "sast")]
    findings = spark.createDataFrame(rows, "finding_id bigint, type string, file string, line int, severity string, snippet string, origin string")
    generator = lambda p: p.select("finding_id", F.to_json(F.struct(F.col("prompt").alias("suggested_fix"))).alias("answer"))
    got = {r.finding_id: r for r in remediate(findings, chunks, generator, build_bm25(chunks)).attempted.collect()}
    assert asked == [2] and len(got) == 6
    for i in range(5):
        assert f"code {i}" in got[i].parsed.suggested_fix and "sql injection security fix" in got[i].parsed.suggested_fix
        assert [s.source for s in got[i].sources] == ["S1", "S2"]
