"""Remediation: P10, P12-P16, A2-A5, J6, J9, J11, W5, T7, C4."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.functions.text import unescape_newlines
from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators import findings as fd, remediation as rm
from vulnlake.operators.bm25 import build_bm25
from vulnlake.operators.cache import cache_key as key_of
from vulnlake.plans.remediate import remediate


def digest(column):
    return F.md5(F.col(column).cast("binary"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def unescape_snippet(spark, d):
    """Newlines written as two characters and turned back."""
    escaped = v.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("e"))
    return escaped.select("doc_id", F.md5(unescape_newlines(F.col("e")).cast("binary")).alias("digest"))


@query(sql("""
SELECT finding_id, type || CASE WHEN finding_id % 3 = 0 THEN '' ELSE ' ' || bandit_test_id END || ' ' || description || CASE WHEN finding_id % 2 = 0 THEN ' CWE-7' ELSE '' END
  || ' vulnerability security fix' AS text FROM findings""", "findings"))
def retrieval_query(spark, d):
    f = v.findings(spark, d)
    test_id = F.when(F.col("finding_id") % 3 != 0, F.col("bandit_test_id"))
    cwe = F.when(F.col("finding_id") % 2 == 0, "CWE-7").otherwise("")
    return f.select("finding_id", rm.retrieval_query(F.col("type"), test_id, F.col("description"), cwe).alias("text"))


TEMPLATE = "T={finding_type} L={line_number} F={file_path} S={severity} W={cwe_id}\n{original_code}\n--\n{context} {other}"


@query(sql("""
SELECT finding_id, 'T=' || type || ' L=' || line || ' F=' || file || ' S=' || severity || ' W=' || chr(10) || snippet || chr(10) || '--' || chr(10) || '{file_path} ' || description || ' {other}' AS prompt
FROM findings""", "findings"))
def render_prompt(spark, d):
    shaped = fd.normalise_finding(v.findings(spark, d)).withColumn("context", F.concat(F.lit("{file_path} "), "description"))
    return rm.render_prompt(shaped, TEMPLATE).select("finding_id", "prompt")


@query(sql("SELECT finding_id, type || '|' || substr(snippet, 1, 200) AS key FROM findings", "findings"))
def cache_key(spark, d):
    return v.findings(spark, d).select("finding_id", key_of(F.col("type"), F.col("snippet")).alias("key"))


BROKEN = "turn % 4 = 3 AND conv_id % 6 = 1"
PARSED = f"""
SELECT conv_id * 1000 + turn AS finding_id, NOT ({BROKEN}) AS ok,
  CASE WHEN {BROKEN} THEN '' ELSE 'fix ' || conv_id || chr(10) || '  "' || role || '"' END AS suggested_fix,
  CASE WHEN {BROKEN} THEN '' ELSE text END AS explanation,
  CASE WHEN {BROKEN} OR turn % 3 <> 0 THEN '' ELSE 'High' END AS confidence FROM conversations"""


@query(PARSED)
def parse_response(spark, d):
    parsed = v.responses(spark, d).withColumn("p", rm.parse_response(F.col("answer")))
    fields = [F.coalesce(f"p.{f}", F.lit("")).alias(f) for f in ("suggested_fix", "explanation", "confidence")]
    return parsed.select("finding_id", F.col("p").isNotNull().alias("ok"), *fields)


@query(f"""
SELECT finding_id, CASE WHEN finding_id % 2 = 0 THEN 'x' ELSE '' END || ':' || suggested_fix AS fix, CASE WHEN confidence = '' THEN 'Unknown' ELSE confidence END AS confidence,
  '' AS cwe_id, 'Unknown/guide, s' || (finding_id % 10) || '/Unknown' AS sources FROM ({PARSED}) WHERE ok""")
def remediation_record(spark, d):
    src = F.struct(F.lit(None).cast("string").alias("source"), F.lit("guide").alias("doc_type"))
    doc = F.struct(F.concat(F.lit("s"), v.text_of(F.col("finding_id") % 10)).alias("source"), F.lit(None).cast("string").alias("doc_type"))
    parsed = v.responses(spark, d).select(
        "finding_id",
        F.when(F.col("finding_id") % 2 == 0, "x").otherwise("").alias("snippet"),
        rm.parse_response(F.col("answer")).alias("parsed"),
        F.array(src, doc).alias("sources"),
    )
    records = rm.remediation_record(parsed, ["snippet"])
    listed = F.transform("source_documents", lambda s: F.concat(s["source"], F.lit("/"), s["doc_type"]))
    return records.select(
        "finding_id", F.concat("finding.snippet", F.lit(":"), "suggested_fix").alias("fix"), "confidence", "cwe_id",
        F.array_join(listed, ", ").alias("sources"),
    )


@query(sql("""
SELECT finding_id, md5(CASE WHEN turn = 0 THEN 'cached ' || finding_id ELSE answer END) AS digest, turn = 0 AS from_cache FROM responses""", "responses"))
def attach_responses(spark, d):
    answers = v.responses(spark, d)
    hits = answers.where(F.col("turn") == 0).select("finding_id", F.concat(F.lit("cached "), v.text_of("finding_id")).alias("result"))
    return rm.attach_responses(answers.select("finding_id"), answers, hits).select("finding_id", digest("answer").alias("digest"), "from_cache")


@query(sql("SELECT finding_id, md5('echo ' || answer) AS digest FROM responses", "responses"))
def generate_answers(spark, d):
    prompts = v.responses(spark, d).withColumnRenamed("answer", "prompt")
    answers = rm.generate(prompts, lambda: (lambda prompt: "echo " + prompt))
    return answers.select("finding_id", digest("answer").alias("digest"))


CHOICE = "CASE WHEN finding_id = (SELECT max(finding_id) * 9 // 10 FROM findings) THEN 'q' WHEN finding_id % 3 = 0 THEN 'n' ELSE 'Y' END"


def reviewed(spark, d):
    f = v.findings(spark, d).withColumnRenamed("finding_id", "position")
    last = f.agg(F.floor(F.max("position") * 9 / 10)).scalar()
    choice = F.when(F.col("position") == last, "q").when(F.col("position") % 3 == 0, "n").otherwise("Y")
    return rm.apply_review(f, f.select("position", choice.alias("choice")))


@query(sql(f"""
SELECT finding_id AS position, severity FROM (SELECT *, {CHOICE} AS choice, max(CASE WHEN {CHOICE} = 'q' THEN 1 ELSE 0 END) OVER (ORDER BY finding_id) AS stopped FROM findings)
WHERE stopped = 0 AND choice = 'Y'""", "findings"))
def apply_review(spark, d):
    return reviewed(spark, d).select("position", "severity")


def remediations(spark, d):
    """Code and dependency findings with their origin, as remediated."""
    both = fd.union_findings(v.findings(spark, d), v.vulnerable(spark, d).withColumnRenamed("dep_id", "finding_id"))
    return both.withColumn("finding", F.struct("type", "file", "line", "package", "version"))


@query(sql("SELECT (SELECT count(*) FROM findings) AS sast_findings_count, (SELECT count(*) FROM vulnerable) AS cve_findings_count", "findings", "vulnerable"))
def origin_counts(spark, d):
    all_of = remediations(spark, d)
    return rm.origin_counts(all_of, all_of.where(F.col("origin") == "sast"))


@query(sql("SELECT (SELECT count(*) FROM findings) AS sast_findings_count, (SELECT count(*) FROM vulnerable) AS cve_findings_count", "findings", "vulnerable"))
def origin_counts_by_column(spark, d):
    return rm.origin_counts_by_column(remediations(spark, d))


@query(sql("""
SELECT severity, sum(n)::BIGINT AS n FROM (SELECT coalesce(lower(issue_severity), 'medium') AS severity, 1 AS n FROM results
  UNION ALL SELECT unnest(['critical', 'high', 'medium', 'low']), 0) GROUP BY 1""", "results"))
def count_by_severity(spark, d):
    return rm.count_by_severity(v.results(spark, d), "issue_severity")


@query(f"""
SELECT confidence, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN confidence = '' THEN 'Medium' ELSE confidence END AS confidence, 1 AS n FROM ({PARSED}) WHERE ok
  UNION ALL SELECT unnest(['High', 'Medium', 'Low']), 0) GROUP BY 1""")
def count_by_confidence(spark, d):
    parsed = v.responses(spark, d).select(rm.parse_response(F.col("answer")).alias("p")).where(F.col("p").isNotNull())
    return rm.count_by_confidence(parsed.select(F.col("p.confidence").alias("confidence")))


@query(f"SELECT count(*) FILTER (ok) AS successful_remediations, count(*) FILTER (NOT ok) AS failed_remediations FROM ({PARSED})")
def success_failure(spark, d):
    return rm.success_failure(v.responses(spark, d).select(rm.parse_response(F.col("answer")).alias("parsed")))


@query(sql(f"""
SELECT 'stand-in' AS llm_info, (SELECT count(*) FROM conversations) AS total_findings, count(*) AS sast_findings_count, 0::BIGINT AS cve_findings_count,
  (SELECT count(*) FILTER (ok) FROM ({PARSED})) AS successful_remediations, (SELECT count(*) FILTER (NOT ok) FROM ({PARSED})) AS failed_remediations,
  count(*) FILTER (severity = 'critical') AS severity_critical, count(*) FILTER (severity = 'high') AS severity_high,
  count(*) FILTER (severity = 'medium') AS severity_medium, count(*) FILTER (severity = 'low') AS severity_low, 0::BIGINT AS other_severity,
  0::BIGINT AS confidence_high, 0::BIGINT AS confidence_medium, 0::BIGINT AS confidence_low, count(*) AS other_confidence
FROM (SELECT *, {CHOICE} AS choice, max(CASE WHEN {CHOICE} = 'q' THEN 1 ELSE 0 END) OVER (ORDER BY finding_id) AS stopped FROM findings)
WHERE stopped = 0 AND choice = 'Y'""", "findings"))
def remediation_summary(spark, d):
    attempted = v.responses(spark, d).select(rm.parse_response(F.col("answer")).alias("parsed"))
    approved = reviewed(spark, d).withColumn("origin", F.lit("sast"))
    return rm.remediation_summary(attempted, approved, "stand-in").drop("scan_timestamp", "remediation_timestamp")


@query(sql("""
SELECT count(*) AS total_findings, count(*) AS successful_remediations, count(*) FILTER (origin = 'sast') AS sast_findings_count,
  count(*) FILTER (severity = 'high') AS severity_high, count(*) AS confidence_high
FROM (SELECT 'sast' AS origin, severity FROM findings UNION ALL SELECT 'cve', 'medium' FROM vulnerable)""", "findings", "vulnerable"))
def remediate_findings(spark, d):
    """The whole run over all findings, with a stand-in model that echoes the file."""
    chunks = v.chunks(spark, d).select(
        "chunk_id", "content", "source", F.col("lang").alias("doc_type"), embed_hashed(F.col("content")).alias("embedding")
    )
    # Snippets carry the line number's text only in part, so many findings share a key.
    found = remediations(spark, d).withColumn("finding_id", F.col("finding_id") + F.when(F.col("origin") == "cve", 1 << 40).otherwise(0))

    def generator(prompts):
        answer = F.to_json(F.struct(F.md5(F.col("prompt").cast("binary")).alias("suggested_fix"), F.lit("High").alias("confidence")))
        return prompts.select("finding_id", answer.alias("answer"))

    result = remediate(found, chunks, generator, build_bm25(chunks), min_docs=5)
    return result.summary.select(
        "total_findings", "successful_remediations", "sast_findings_count", "severity_high", "confidence_high"
    )


# Every vulnerable dependency in turn, with its token counts; the cache first holds an answer with
# sources under the key of the smallest finding, and another writer's bare answer.
BUCKETS = "list_transform(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> ''), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64)"
CACHED = """,
keyed AS (SELECT dep_id, row_number() OVER (ORDER BY dep_id) - 1 AS number,
  substr('Vulnerable Dependency: ' || package, 1, 999) || '|' || substr(package || '==' || version || chr(10) || 'CVEs: ' || replace(cves, ',', ', '), 1, 200) AS key FROM vulnerable),
every AS (SELECT dep_id, number, key FROM keyed UNION ALL SELECT NULL, -2, key FROM keyed WHERE number = 0 UNION ALL SELECT NULL, -1, 'quite another key'),
counted AS (SELECT dep_id, number, list_transform(range(0, 64), lambda b: len(list_filter(buckets, lambda x: x = b))::DOUBLE) AS c FROM (SELECT dep_id, number, %s AS buckets FROM every)),
units AS MATERIALIZED (SELECT dep_id, number, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM counted),
walk AS (
  SELECT -1::BIGINT AS number, NULL::BIGINT AS dep_id, NULL::BIGINT AS source, (SELECT list({'n': number, 'u': u} ORDER BY number) FROM units WHERE number < 0) AS held
  UNION ALL
  SELECT number, dep_id, coalesce(hit, number), CASE WHEN hit IS NULL THEN list_append(held, {'n': number, 'u': u})[-100:] ELSE held END
  FROM (SELECT *, list_filter(held, lambda e: list_dot_product(e.u, u) >= 0.85)[1].n AS hit FROM (SELECT x.number, x.dep_id, w.held, x.u FROM walk w JOIN units x ON x.number = w.number + 1)))
SELECT w.dep_id AS finding_id, w.source <> w.number AS from_cache, CASE w.source WHEN -2 THEN 'stored fix' WHEN -1 THEN 'bare fix' ELSE 'fix ' || k.dep_id END AS suggested_fix,
  w.source = -2 AS stored_sources
FROM walk w LEFT JOIN keyed k ON k.number = w.source WHERE w.number >= 0""" % BUCKETS.format("key")


@query(sql("", "vulnerable").replace("WITH ", "WITH RECURSIVE ", 1) + CACHED)
def remediate_with_cache(spark, d):
    """A whole run over the dependencies with a cache: who is asked, and whose answer each one gets."""
    found = v.vulnerable(spark, d).withColumnRenamed("dep_id", "finding_id").withColumns({"origin": F.lit("cve"), "severity": F.lit(None).cast("string")})
    chunks = v.table(spark, d, "benchmark").select(
        F.col("item_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("b").alias("source"), F.lit("guide").alias("doc_type"), embed_hashed(F.col("text")).alias("embedding")
    )

    def generator(prompts):
        fix = F.concat(F.lit("fix "), v.text_of("finding_id"))
        return prompts.select("finding_id", F.to_json(F.struct(fix.alias("suggested_fix"))).alias("answer"))

    first = fd.normalise_finding(found.orderBy("finding_id").limit(1)).select(key_of(F.col("finding_type"), F.col("code")).alias("key"))
    stored = '{"answer": "{\\"suggested_fix\\": \\"stored fix\\"}", "sources": [{"rank": 1, "source": "old", "doc_type": "guide"}]}'
    entries = first.select(F.lit(7).cast("bigint").alias("seq"), "key", F.lit(stored).alias("result"))
    bare = first.select(F.lit(8).cast("bigint").alias("seq"), F.lit("quite another key").alias("key"), F.lit('{"suggested_fix": "bare fix"}').alias("result"))
    cache = entries.unionByName(bare).withColumn("embedding", embed_hashed(F.col("key")).cast("array<double>"))
    run = remediate(found, chunks, generator, build_bm25(chunks), cache=cache)
    return run.attempted.select(
        "finding_id", "from_cache", "parsed.suggested_fix", F.exists("sources", lambda s: s["source"] == "old").alias("stored_sources")
    )
