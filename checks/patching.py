"""Patching: F6, A8, A15, J7, J8, J10, P11, T6, T9, U5, W6, W7, C5."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.domain import FUZZY_THRESHOLD
from vulnlake.functions.similarity import levenshtein_bound, levenshtein_ratio_above
from vulnlake.operators import locating as lc, patching as pt
from vulnlake.plans.changes import prepare_changes


def long(name):
    return F.col(name).cast("bigint").alias(name)


@query(sql("SELECT fix_id FROM fixes WHERE (fix_id % 3 <> 0) AND length(snippet) > 0", "fixes"))
def patchable(spark, d):
    fixes = v.fixes(spark, d).withColumn("suggested_fix", F.when(F.col("fix_id") % 3 == 0, "").otherwise(F.col("suggested_fix")))
    return lc.patchable(fixes).select("fix_id")


@query(sql("""
SELECT path, fix_id, row_number() OVER (PARTITION BY path ORDER BY coalesce(CASE WHEN fix_id % 6 <> 0 THEN line END, 0) DESC, fix_id) AS fix_order FROM fixes""", "fixes"))
def group_fixes_by_file(spark, d):
    fixes = v.fixes(spark, d).withColumn("line", F.when(F.col("fix_id") % 6 != 0, F.col("line")))
    return lc.group_fixes(fixes).select("path", "fix_id", long("fix_order"))


@query(sql("""
SELECT path, line_no AS start, md5(string_agg(line, chr(10)) OVER w) AS digest FROM file_lines
WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY line_no <= n - 2""", "file_lines"))
def line_windows(spark, d):
    rows = lc.line_windows(v.files(spark, d), 3)
    return rows.select("path", long("start"), F.md5(F.col("window").cast("binary")).alias("digest"))


@query(sql("""
, code AS (SELECT path, line_no, length(line) - length(ltrim(line)) AS indent, ltrim(line) LIKE 'def %' AS head FROM file_lines WHERE trim(line) <> ''),
stops AS (SELECT h.path, h.line_no AS start, min(c.line_no) AS stop FROM code h LEFT JOIN code c ON c.path = h.path AND c.line_no > h.line_no AND c.indent <= h.indent
  WHERE h.head GROUP BY ALL)
SELECT s.path, s.start, max(c.line_no) AS "end" FROM stops s JOIN code c ON c.path = s.path AND c.line_no >= s.start AND (stop IS NULL OR c.line_no < stop) GROUP BY ALL""", "file_lines"))
def block_extent(spark, d):
    return lc.block_extent(v.files(spark, d)).select("path", long("start"), long("end"))


NEAR = """
, near AS (SELECT f.fix_id, f.path, f.line, f.snippet, l.line_no AS start, l.line AS text,
    trim(replace(f.snippet, '  # ', ' # ')) AS a, trim(replace(l.line, '  # ', ' # ')) AS b
  FROM fixes f JOIN file_lines l ON l.path = f.path AND l.line_no BETWEEN f.line - 10 AND f.line + 10),
exact AS (SELECT fix_id, path, line, min(start) AS start FROM near WHERE a = b AND a <> '' GROUP BY ALL)"""


@query(sql(NEAR + " SELECT fix_id, path, start, 1 AS n_lines FROM exact", "fixes"))
def locate_exact(spark, d):
    found = lc.locate_exact(v.fixes(spark, d), v.files(spark, d))
    return found.select("fix_id", "path", long("start"), "n_lines")


@query(sql(NEAR + """
SELECT fix_id, start, round(1 - levenshtein(trim(snippet), trim(text))::DOUBLE / greatest(length(trim(snippet)), length(trim(text))), 6) AS ratio
FROM near WHERE fix_id NOT IN (SELECT fix_id FROM exact) AND trim(text) <> '' AND ratio >= 0.85
QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY ratio DESC, start) = 1""", "fixes"))
def locate_fuzzy_levenshtein(spark, d):
    """Edit distance in place of the matcher, which SQL does not have."""
    found = lc.locate_fuzzy(
        v.fixes(spark, d), v.files(spark, d), similarity=levenshtein_ratio_above(FUZZY_THRESHOLD), bound=levenshtein_bound
    )
    return found.select("fix_id", long("start"), "ratio")


@query()
def locate_fuzzy(spark, d):
    """With the stdlib matcher; tested against brute force."""
    return lc.locate_fuzzy(v.fixes(spark, d), v.files(spark, d)).select("fix_id", "start", "ratio")


@query(sql("""
SELECT path, md5(string_agg(CASE WHEN trim(line) = '' THEN '' ELSE repeat(' ', 2 + length(line) - length(ltrim(line)) - least) || ltrim(line) END, chr(10) ORDER BY line_no)) AS digest
FROM (SELECT *, coalesce(min(CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END) OVER (PARTITION BY path), 0) AS least
  FROM (SELECT path, i AS line_no, l[i] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM files)))) GROUP BY path""", "files"))
def reindent(spark, d):
    shifted = lc.reindent(F.col("content"), F.lit(2))
    return v.files(spark, d).select("path", F.md5(shifted.cast("binary")).alias("digest"))


IMPORT = "(ltrim(line) LIKE 'import %' OR ltrim(line) LIKE 'from %')"


@query(sql(f"SELECT DISTINCT path, trim(line) AS import_line FROM file_lines WHERE {IMPORT}", "file_lines"))
def file_imports(spark, d):
    return lc.file_imports(v.files(spark, d))


@query(sql(f"""
SELECT path, coalesce(md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT imp AND line_no BETWEEN lo AND hi)), md5('')) AS digest
FROM (SELECT *, min(CASE WHEN NOT imp AND trim(line) <> '' THEN line_no END) OVER w AS lo, max(CASE WHEN NOT imp AND trim(line) <> '' THEN line_no END) OVER w AS hi
  FROM (SELECT *, {IMPORT} AS imp FROM file_lines) WINDOW w AS (PARTITION BY path)) GROUP BY path""", "file_lines"))
def code_without_imports(spark, d):
    return v.files(spark, d).select("path", F.md5(lc.without_imports(F.col("content")).cast("binary")).alias("digest"))


@query(sql(f"""
SELECT DISTINCT path, split_part(suggested_fix, chr(10), 1) AS import_line FROM fixes
EXCEPT SELECT path, trim(line) FROM file_lines WHERE {IMPORT}""", "fixes"))
def missing_imports(spark, d):
    return lc.missing_imports(v.fixes(spark, d), v.files(spark, d))


@query(sql(f"""
, kinds AS (SELECT path, line_no, {IMPORT} AS imp, trim(line) = '' OR ltrim(line) LIKE '#%' AS soft FROM file_lines),
firsts AS (SELECT path, min(CASE WHEN imp THEN line_no END) AS first, min(CASE WHEN NOT soft THEN line_no END) AS code FROM kinds GROUP BY path),
stops AS (SELECT k.path, min(line_no) AS stop FROM kinds k JOIN firsts USING (path) WHERE line_no > first AND NOT imp AND NOT soft GROUP BY k.path),
lasts AS (SELECT k.path, max(line_no) AS last FROM kinds k LEFT JOIN stops USING (path) WHERE imp AND (stop IS NULL OR line_no < stop) GROUP BY k.path)
SELECT path, coalesce(last, code - 1, 0) AS anchor FROM firsts LEFT JOIN lasts USING (path)""", "file_lines"))
def import_anchor(spark, d):
    return lc.import_anchor(v.files(spark, d)).select("path", long("anchor"))


@query()
def patch_files(spark, d):
    """Sequential edits per file; tested by goldens."""
    return pt.patch_files(v.files(spark, d), v.fixes(spark, d))


@query(sql("SELECT path, count(*) AS fixes FROM fixes GROUP BY path", "fixes"))
def patch_counts(spark, d):
    """Every patchable fix is either applied or reported."""
    done = pt.patch_files(v.files(spark, d), v.fixes(spark, d)).where(F.col("kind") == "file")
    return done.select("path", (F.col("n_applied") + F.col("n_failed")).alias("fixes"))


@query("""
SELECT page_id, coalesce(regexp_extract(url, '^http://[^/]*/(.*)$', 1), '') AS relative_path, CASE WHEN url LIKE 'https:%' THEN 'outside' ELSE '' END AS error
FROM (SELECT page_id, replace(url, '#', '/') AS url FROM pages)""")
def relative_path(spark, d):
    page = v.table(spark, d, "pages").select("page_id", F.replace("url", F.lit("#"), F.lit("/")).alias("url"))
    host = F.regexp_extract("url", r"^https?://[^/]*", 0)
    paths = page.select("page_id", F.replace("url", F.lit("/"), F.lit("\\")).alias("path"), F.regexp_replace(host, "^https", "http").alias("root"))
    inside, outside = pt.relative_paths(paths)
    return inside.select("page_id", "relative_path", F.lit("").alias("error")).unionByName(
        outside.select("page_id", F.lit("").alias("relative_path"), F.lit("outside").alias("error"))
    )


@query(sql("""
SELECT count(*) AS files, sum(fixes)::BIGINT AS fixes FROM (SELECT path, count(*) AS fixes FROM fixes WHERE fix_id % 4 IN (0, 1) GROUP BY path)""", "fixes"))
def prepare_change_set(spark, d):
    """The whole change set: high and critical fixes with high confidence."""
    fixes = v.fixes(spark, d).select(
        "fix_id", F.concat(F.lit("/r/"), "path").alias("file"), "line", "snippet", "suggested_fix",
        F.element_at(F.array(*map(F.lit, ["high", "critical", "low", "medium"])), (F.col("fix_id") % 4 + 1).cast("int")).alias("severity"),
        F.lit("High").alias("confidence"), F.lit("Unknown Vulnerability").alias("type"), F.lit("why").alias("explanation"), F.lit("CWE-1").alias("cwe_id"),
        F.array(F.struct(F.lit("s").alias("source"), F.lit("cwe").alias("doc_type"))).alias("source_documents"),
    )
    files = v.files(spark, d).withColumn("path", F.concat(F.lit("/r/"), "path"))
    change = prepare_changes(fixes, files, "/r")
    return change.changed_files.agg(F.count("*").alias("files"), F.sum(F.col("n_applied") + F.col("n_failed")).alias("fixes"))
