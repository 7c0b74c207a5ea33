"""Findings: P4-P7, F1-F5, A1, A9-A12, U1, T8, C1."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.operators import changes, findings as fd
from vulnlake.plans.scan import scan

RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END"
SKIP = ["B101", "B201"]
DIRS = ["tests", "venv", ".github", "**/*.json"]
KEPT_FILE = "NOT (regexp_matches(filename, '(^|/)tests(/|$)') OR filename LIKE '%.json')"

RULES = [
    fd.PatternRule("B105", r"token\s*=\s*\"[0-9a-f]{40}\"", "high", "high"),
    fd.PatternRule("B104", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "medium", "medium"),
    fd.PatternRule("X001", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", "low", "high"),
    fd.PatternRule("B113", r"https?://", "low", "low"),
]


@query(sql("SELECT finding_id, test_id, type FROM (SELECT r.finding_id, r.test_id, coalesce(f.type, 'Unknown Vulnerability') AS type FROM results r LEFT JOIN (SELECT DISTINCT bandit_test_id, type FROM findings) f ON r.test_id = f.bandit_test_id)", "findings"))
def classify_finding(spark, d):
    return fd.classify(v.results(spark, d)).select("finding_id", "test_id", "type")


@query(sql("""
SELECT finding_id, lower(coalesce(issue_severity, 'low')) AS severity, lower(coalesce(issue_confidence, 'low')) AS confidence,
  CASE WHEN issue_severity = 'UNDEFINED' THEN 'unknown severity: undefined' ELSE '' END AS reason FROM results""", "results"))
def normalise_levels(spark, d):
    good, bad = fd.normalise_levels(v.results(spark, d))
    columns = ["finding_id", "severity", "confidence"]
    return good.select(*columns, F.lit("").alias("reason")).unionByName(bad.select(*columns, "reason"))


@query(sql("SELECT finding_id, snippet FROM findings", "findings"))
def clean_snippet(spark, d):
    return v.findings(spark, d).select("finding_id", "snippet")


@query(sql("""
SELECT finding_id, type AS finding_type, file AS file_path, CAST(line AS VARCHAR) AS line_number, snippet AS code, severity AS level, '' AS cwe FROM findings
UNION ALL SELECT dep_id, 'Vulnerable Dependency: ' || package, file, 'N/A',
  package || '==' || version || chr(10) || 'CVEs: ' || replace(cves, ',', ', '), 'High', '' FROM vulnerable""", "findings", "vulnerable"))
def normalise_finding(spark, d):
    both = fd.union_findings(v.findings(spark, d), v.vulnerable(spark, d).withColumnRenamed("dep_id", "finding_id"))
    return fd.normalise_finding(both).select(
        "finding_id", "finding_type", "file_path", "line_number", "code", "level", "cwe"
    )


@query(sql(f"""
SELECT finding_id, severity, confidence FROM findings
WHERE {RANK.format('severity')} >= 2 AND {RANK.format('confidence')} >= 2""", "findings"))
def min_level(spark, d):
    return fd.min_level(v.findings(spark, d)).select("finding_id", "severity", "confidence")


@query(sql(f"SELECT finding_id, test_id, filename FROM results WHERE test_id NOT IN ('B101', 'B201') AND {KEPT_FILE}", "results"))
def exclude_paths(spark, d):
    return fd.exclude(v.results(spark, d), SKIP, DIRS, file="filename").select("finding_id", "test_id", "filename")


@query(sql("""
SELECT 'sast' AS origin, finding_id, file, type, '' AS package FROM findings
UNION ALL SELECT 'cve', dep_id, file, '', package FROM vulnerable""", "findings", "vulnerable"))
def union_findings(spark, d):
    both = fd.union_findings(v.findings(spark, d), v.vulnerable(spark, d).withColumnRenamed("dep_id", "finding_id"))
    empty = F.lit("")
    return both.select(
        "origin", "finding_id", "file", F.coalesce("type", empty).alias("type"), F.coalesce("package", empty).alias("package")
    )


@query(sql("SELECT 'sast' AS mode, finding_id FROM findings UNION ALL SELECT 'cve', dep_id FROM vulnerable", "findings", "vulnerable"))
def select_origin(spark, d):
    both = fd.union_findings(v.findings(spark, d), v.vulnerable(spark, d).withColumnRenamed("dep_id", "finding_id"))
    sast = fd.select_origin(both, sast_only=True, cve_only=True)
    cve = fd.select_origin(both, cve_only=True)
    return sast.select(F.lit("sast").alias("mode"), "finding_id").union(cve.select(F.lit("cve").alias("mode"), "finding_id"))


@query(sql(f"SELECT finding_id, coalesce(issue_severity, '') AS severity FROM results WHERE coalesce({RANK.format('lower(issue_severity)')}, 1) >= 3", "results"))
def severity_at_least(spark, d):
    kept = fd.severity_at_least(v.results(spark, d), "high", severity="issue_severity")
    return kept.select("finding_id", F.coalesce("issue_severity", F.lit("")).alias("severity"))


@query(sql("SELECT finding_id, severity, confidence FROM findings WHERE severity IN ('high', 'critical') AND confidence = 'high'", "findings"))
def change_worthy(spark, d):
    return changes.change_worthy(v.findings(spark, d)).select("finding_id", "severity", "confidence")


@query(sql("SELECT count(*) > 0 AS worthy FROM findings WHERE severity IN ('high', 'critical') AND confidence = 'high'", "findings"))
def any_change_worthy(spark, d):
    return changes.any_rows(changes.change_worthy(v.findings(spark, d)))


@query(sql("""
SELECT count(*) AS total_findings, (SELECT count(*) FROM vulnerable) AS total_cve_findings,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM findings""", "findings", "vulnerable"))
def scan_summary(spark, d):
    return fd.scan_summary(v.findings(spark, d), v.vulnerable(spark, d))


@query(sql("""
SELECT repo, CASE WHEN count(DISTINCT dir) = 1 THEN repo || '/' || min(dir) ELSE repo END AS common_root
FROM (SELECT split_part(file, '/', 1) AS repo, split_part(file, '/', 2) AS dir FROM findings) GROUP BY repo""", "findings"))
def common_root(spark, d):
    return fd.common_root(v.findings(spark, d).withColumn("repo", F.substring_index("file", "/", 1)), by=["repo"])


@query(sql("""
SELECT repo, count(*) AS total, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'high') THEN 'high'
    WHEN bool_or(severity = 'medium') THEN 'medium' ELSE 'low' END AS highest,
  array_to_string(list_slice(list_sort(list(DISTINCT type)), 1, 3), ', ') || CASE WHEN count(DISTINCT type) > 3 THEN ', ...' ELSE '' END AS types,
  'Fix ' || total || ' ' || highest || ' vulnerabilities (' || types || ')' AS headline,
  'Fix ' || total || ' ' || highest || ' security vulnerabilities' AS title
FROM (SELECT *, split_part(file, '/', 1) AS repo FROM findings) GROUP BY repo""", "findings"))
def change_headline(spark, d):
    return changes.change_headline(v.findings(spark, d).withColumn("repo", F.substring_index("file", "/", 1)), ["repo"])


@query(sql("""
SELECT file, 'vulnlake-' || CASE WHEN bool_or(severity = 'critical') THEN 'critical-fixes' WHEN bool_or(severity = 'high') THEN 'high-severity'
  ELSE 'automated-fixes' END || '-20310715-080910' AS label FROM findings GROUP BY file""", "findings"))
def batch_label(spark, d):
    return changes.batch_label(v.findings(spark, d), F.lit("2031-07-15 08:09:10").cast("timestamp"), ["file"])


@query(sql("""
SELECT file, number, '| ' || type || ' | `' || file || '` | ' || line || ' | **' || severity || '** | ' || confidence || ' | N/A |' AS text
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY finding_id) AS number FROM findings)""", "findings"))
def change_table(spark, d):
    numbered = changes.number_changes(v.findings(spark, d).withColumn("cwe_id", F.lit(None).cast("string")), ["finding_id"], ["file"])
    return numbered.select("file", "number", changes.table_line().alias("text"))


@query(sql("""
WITH worthy AS (SELECT *, row_number() OVER (ORDER BY finding_id) AS number FROM findings WHERE severity IN ('high', 'critical') AND confidence = 'high')
SELECT section, number, part, md5(text) AS digest FROM (
  SELECT 1 AS section, 0 AS number, 0 AS part, '## Security fixes' || chr(10) AS text
  UNION ALL SELECT 1, 0, 1, 'This change repairs ' || (SELECT count(*) FROM worthy) || ' findings.' || chr(10)
  UNION ALL SELECT 1, 0, 2, '| Type | File | Line | Severity | Confidence | CWE |'
  UNION ALL SELECT 1, 0, 3, '|------|------|------|----------|------------|-----|'
  UNION ALL SELECT 2, number, 0, '| ' || type || ' | `' || file || '` | ' || line || ' | **' || severity || '** | ' || confidence || ' | CWE-1 |' FROM worthy
  UNION ALL SELECT 3, number, 0, '### ' || file || ' line ' || line || repeat(chr(10), 2) || 'Fix ' || number || ' for ' || type || chr(10) || 'Severity: ' || severity
    || ', confidence: ' || confidence || repeat(chr(10), 2) || description || repeat(chr(10), 2) || 'Before:' || chr(10) || '```python' || chr(10) || snippet
    || chr(10) || '```' || repeat(chr(10), 2) || 'After:' || chr(10) || '```python' || chr(10) || 'pass' || chr(10) || '```' || chr(10) FROM worthy
  UNION ALL SELECT 4, 0, 0, '* read by two' UNION ALL SELECT 4, 0, 1, '* deployed'
  UNION ALL SELECT 5, number, 0, '- fix ' || number || ': ' || bandit_test_id || ' (cwe)' FROM worthy)""".replace("WITH worthy", ", worthy", 1), "findings"))
def change_report(spark, d):
    worthy = changes.change_worthy(v.findings(spark, d)).withColumns(
        {
            "cwe_id": F.lit("CWE-1"),
            "explanation": F.col("description"),
            "suggested_fix": F.lit("pass"),
            "source_documents": F.array(F.struct(F.col("bandit_test_id").alias("source"), F.lit("cwe").alias("doc_type"))),
        }
    )
    report = changes.change_report(changes.number_changes(worthy, ["finding_id"]), checklist=["* read by two", "* deployed"])
    return report.select("section", "number", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(sql("""
SELECT doc_id, line_no AS line, test_id, type, severity, confidence, trim(line, ' ') AS snippet FROM lines, (VALUES
  ('B105', 'Hardcoded Secret', 'high', 'high', 'token\\s*=\\s*"[0-9a-f]{40}"'),
  ('B104', 'Hardcoded Secret', 'medium', 'medium', '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'),
  ('X001', 'Unknown Vulnerability', 'low', 'high', '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+'),
  ('B113', 'Insecure Configuration', 'low', 'low', 'https?://')) AS r(test_id, type, severity, confidence, pattern)
WHERE regexp_matches(lines.line, pattern)""".replace("trim(line,", "trim(lines.line,"), "lines"))
def rule_scan(spark, d):
    found = fd.rule_scan(v.table(spark, d, "documents"), RULES, key="doc_id", text="text")
    return found.withColumn("line", F.col("line").cast("bigint"))


@query(sql(f"""
SELECT f.finding_id, f.type, f.severity, f.confidence FROM findings f JOIN results r USING (finding_id)
WHERE {RANK.format('f.severity')} >= 2 AND {RANK.format('f.confidence')} >= 2 AND r.test_id NOT IN ('B101', 'B201') AND {KEPT_FILE}""", "findings"))
def scan_findings(spark, d):
    kept = fd.exclude(v.results(spark, d), SKIP, DIRS, file="filename")
    good, _ = fd.normalise_levels(fd.classify(kept))
    return fd.min_level(good).select("finding_id", "type", "severity", "confidence")


@query(sql(f"""
SELECT count(*) AS total_findings, (SELECT count(*) FROM vulnerable) AS total_cve_findings,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical
FROM findings f JOIN results r USING (finding_id)
WHERE {RANK.format('f.severity')} >= 2 AND {RANK.format('f.confidence')} >= 2 AND r.test_id NOT IN ('B101', 'B201') AND {KEPT_FILE}""", "findings", "vulnerable"))
def scan_report(spark, d):
    return scan(v.results(spark, d), v.deps(spark, d), v.ranges(spark, d), skip_ids=SKIP, exclude_paths=DIRS).summary
