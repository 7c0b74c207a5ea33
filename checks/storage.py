"""Readers and writers on data derived from the tables: S1, S2, S5, S6, S10-S17.

The tables are first written in the format to be read, below the session's shared
folder, in files of bounded size whose number grows with the data.
"""

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.remediation import PARSED
from checks.views import sql
from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators import findings as fd, remediation as rm
from vulnlake.operators.dependencies import match_advisories
from vulnlake.operators.patching import patch_files
from vulnlake.operators.ranking import number_rows
from vulnlake.session import shared_dir, stage
from vulnlake.sources import corpus, findings as sf, index, manifests, sinks


def folder(spark, label):
    return f"{shared_dir(spark)}/vulnlake/{label}-{uuid.uuid4().hex}"


def weakness_csv(spark, d, label):
    """Documents as weakness CSV files of a hundred rows."""
    path = folder(spark, label)
    i = F.col("doc_id")
    rows = v.table(spark, d, "documents").select(
        F.floor(i / 100).alias("part"), i.alias("CWE-ID"), F.col("source").alias("Name"), F.col("lang").alias("Description"),
        F.col("text").alias("Extended Description"),
    )
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.repartition("part").write.partitionBy("part").options(**options).csv(path)
    return path


@query("SELECT doc_id // 100 AS part, '.csv' AS ext, true AS filled FROM documents GROUP BY ALL")
def corpus_scan(spark, d):
    found = corpus.corpus_scan(spark, weakness_csv(spark, d, "scan"))
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint")
    return found.select(part.alias("part"), "ext", ((F.col("length") > 0) & (F.length("content") == F.col("length"))).alias("filled"))


WEAKNESS = """
SELECT 'CWE-' || doc_id AS cwe_id, source AS vulnerability_type, md5('CWE-' || doc_id || ': ' || source || repeat(chr(10), 2) || 'Description: ' || lang || repeat(chr(10), 2)
  || 'Extended Description: ' || text || repeat(chr(10), 2)) AS digest FROM documents"""


@query(WEAKNESS)
def read_weaknesses(spark, d):
    docs = corpus.read_weaknesses(spark, weakness_csv(spark, d, "weak"))
    return docs.select("cwe_id", "vulnerability_type", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(WEAKNESS)
def load_corpus(spark, d):
    docs, failed = corpus.load_corpus(spark, weakness_csv(spark, d, "corpus"))
    return docs.select("cwe_id", "vulnerability_type", F.md5(F.col("content").cast("binary")).alias("digest")).unionByName(
        failed.select(F.col("path").alias("cwe_id"), F.lit("failed").alias("vulnerability_type"), F.col("error").alias("digest"))
    )


def json_files(spark, rows, key, label):
    """One JSON document per file; ``rows`` holds ``part``, different in each row, and the document.

    Rows are sorted before the documents are written out as text, so that only what ``key`` is made of is moved.
    """
    path = folder(spark, label)
    key = F.col(key) if isinstance(key, str) else key
    rows.sortWithinPartitions("part").select("part", F.to_json(key).alias("value")).write.partitionBy("part").text(path, compression="gzip")
    return path


RESULT_FIELDS = ["test_id", "issue_text", "line_number", "issue_severity", "issue_confidence", "code", "filename"]


@query(sql("""
SELECT test_id, issue_text, line_number, coalesce(issue_severity, '') AS issue_severity, issue_confidence, md5(code) AS digest, filename FROM results""", "results"))
def read_scanner_output(spark, d):
    rows = v.results(spark, d).withColumn("part", F.floor(F.col("finding_id") / 500))
    files = rows.groupBy("part").agg(F.struct(F.collect_list(F.struct(*RESULT_FIELDS)).alias("results")).alias("doc"))
    good, _ = sf.read_scanner_output(spark, json_files(spark, files, "doc", "scanner"))
    return good.select(
        "test_id", "issue_text", "line_number", F.coalesce("issue_severity", F.lit("")).alias("issue_severity"),
        "issue_confidence", F.md5(F.col("code").cast("binary")).alias("digest"), "filename",
    )


@query(sql("SELECT 'sast' AS origin, file, type || severity || line AS what FROM findings UNION ALL SELECT 'cve', file, package || version || cves FROM vulnerable", "findings", "vulnerable"))
def read_report(spark, d):
    """Reports of at most 500 findings of each kind.

    Advisories are matched per report and pin, and an entry's list of them is repeated for each
    manifest when its file is written. Equal pins stand together, so the files compress.
    """
    fields = F.struct("type", "line", "severity", "confidence", "snippet", "file")
    code = v.findings(spark, d).select(F.floor(F.col("finding_id") / 500).alias("part"), fields.alias("code"))
    order = [F.col(c) for c in ("package", "version", "dep_id")]
    deps = number_rows(v.deps(spark, d), [], order, "number", "report-deps")
    pins = deps.groupBy(F.floor((F.col("number") - 1) / 500).alias("part"), "package", "version").agg(F.collect_list("file").alias("files"))
    pins = match_advisories(pins, v.ranges(spark, d)).select("part", F.struct("package", "version", "cves", "files").alias("pin"))
    both = code.unionByName(pins, allowMissingColumns=True)
    both = both.groupBy("part").agg(F.collect_list("code").alias("codes"), F.collect_list("pin").alias("pins"))
    filled = lambda rows: F.when(F.size(rows) > 0, rows)
    of_pin = lambda p: F.transform(p["files"], lambda f: F.struct(p["package"].alias("package"), p["version"].alias("version"), p["cves"].alias("cves"), f.alias("file")))
    doc = F.struct(filled(F.col("codes")).alias("sast_findings"), F.flatten(F.transform(filled(F.col("pins")), of_pin)).alias("cve_findings"))
    rows, _ = sf.read_report(spark, json_files(spark, both, doc, "reports"))
    return rows.select("origin", "file", what())


def what():
    cves = F.array_join("cves", ",")
    return F.when(F.col("origin") == "sast", F.concat("type", "severity", "line")).otherwise(F.concat("package", "version", cves)).alias("what")


@query(sql("SELECT 'sast' AS origin, file, type || severity || line AS what FROM findings UNION ALL SELECT 'cve', file, package || version || cves FROM vulnerable", "findings", "vulnerable"))
def write_report(spark, d):
    path = folder(spark, "report")
    deps = v.vulnerable(spark, d).select("package", "version", "cves", "file")
    sinks.write_report(v.findings(spark, d).drop("finding_id"), deps, path, root="/r")
    return sf.read_report_tables(spark, path).select("origin", "file", what())


@query(sql("SELECT count(*) AS total_findings, (SELECT count(*) FROM vulnerable) AS total_cve_findings, count(*) FILTER (severity = 'high') AS high, '/r' AS repository_root FROM findings", "findings", "vulnerable"))
def report_summary(spark, d):
    summary = sinks.report_summary(v.findings(spark, d), v.vulnerable(spark, d), "/r")
    return summary.select("total_findings", "total_cve_findings", "by_severity.high", "repository_root")


@query(f"SELECT finding_id, suggested_fix, CASE WHEN confidence = '' THEN 'Unknown' ELSE confidence END AS confidence, 'S1' AS source FROM ({PARSED}) WHERE ok")
def write_remediations(spark, d):
    sources = F.array(F.struct(F.lit("S1").alias("source"), F.lit("cwe").alias("doc_type")))
    parsed = v.responses(spark, d).select(
        "finding_id", v.text_of("turn").alias("line"), rm.parse_response(F.col("answer")).alias("parsed"), sources.alias("sources")
    )
    records = rm.remediation_record(parsed, ["line"])
    path = folder(spark, "fixes")
    sinks.write_remediations(records, records.agg(F.count("*").alias("n")), path)
    back = spark.read.schema(records.schema).json(f"{path}/remediations")
    return back.select("finding_id", "suggested_fix", "confidence", F.col("source_documents")[0]["source"].alias("source"))


@query(sql("SELECT (SELECT count(*) FROM idf) AS terms, n AS chunks, (SELECT count(*) FROM tf) AS postings, (SELECT sum(length(content))::BIGINT FROM chunks) AS chars FROM corpus", "idf"))
def stored_index(spark, d):
    """Written, opened again, terms derived anew."""
    path = folder(spark, "index")
    chunks = v.chunks(spark, d).withColumnRenamed("lang", "doc_type").withColumn("embedding", embed_hashed(F.col("content")))
    index.write_index(chunks, path)
    stored, bm25 = index.load_index(spark, path)
    return bm25.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings")).withColumns(
        {"chunks": stored.agg(F.count("*")).scalar(), "chars": stored.agg(F.sum(F.length("content"))).scalar()}
    )


@query(sql("""
SELECT dep_id // 50 AS part, package, version FROM deps WHERE dep_id % 10 NOT IN (3, 5, 7)""", "deps"))
def read_manifests(spark, d):
    from checks.dependencies import requirement_files

    path = folder(spark, "manifests")
    files = requirement_files(spark, d).select(F.substring("file", 2, 20).alias("part"), F.col("content").alias("value"))
    files.repartition("part").write.partitionBy("part").text(path)
    good, _ = manifests.read_manifests(spark, path)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint")
    return good.select(part.alias("part"), "package", "version")


@query("""
SELECT item_id, CAST(i AS INTEGER) AS line_no, md5(l[i]) AS digest FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark))""")
def read_source_files(spark, d):
    path = folder(spark, "code")
    v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    files, _ = sf.read_source_files(spark, path)
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")
    return sf.code_lines(files).select(item.alias("item_id"), "line_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(sql("""
SELECT path, CASE WHEN path LIKE '%3.py' THEN 0 ELSE count(*) END AS fixes, CASE WHEN path LIKE '%3.py' THEN 'File not found' ELSE '' END AS error
FROM fixes GROUP BY path""", "fixes"))
def write_changed_files(spark, d):
    """Some files were renamed since, so their fixes find no file."""
    renamed = F.when(F.col("path").like("%3.py"), "/r/old_").otherwise("/r/")
    files = v.files(spark, d).withColumn("path", F.concat(renamed, "path"))
    fixes = v.fixes(spark, d).withColumn("path", F.concat(F.lit("/r/"), "path"))
    path = folder(spark, "changed")
    sinks.write_changed_files(stage(patch_files(files, fixes), "patched"), "/r", path)
    changed, failed = spark.read.parquet(f"{path}/changed"), spark.read.schema("path string, error string").json(f"{path}/failed")
    return changed.select(
        F.col("relative_path").alias("path"), (F.col("n_applied") + F.col("n_failed")).alias("fixes"), F.lit("").alias("error")
    ).unionByName(failed.select(F.substring("path", 4, 100).alias("path"), F.lit(0).cast("bigint").alias("fixes"), "error"))


@query(sql("SELECT origin, count(*) AS n FROM (SELECT 'sast' AS origin FROM findings UNION ALL SELECT 'cve' FROM vulnerable) GROUP BY 1", "findings", "vulnerable"))
def select_both_origins(spark, d):
    both = fd.union_findings(v.findings(spark, d), v.vulnerable(spark, d))
    return fd.select_origin(both).groupBy("origin").agg(F.count("*").alias("n"))
