"""Derived inputs: the same expressions as Spark frames and as SQL common tables.

Every view covers its whole base table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions.text import clean_snippet
from vulnlake.functions.vectors import embed_hashed
from vulnlake.operators.corpus import chunk_window
from vulnlake.operators.dependencies import match_advisories
from vulnlake.operators.findings import classify, normalise_levels
from vulnlake.session import shared_dir
from vulnlake.sources.index import StoredIndex, open_index, write_index

TEST_IDS = ["B105", "B608", "B602", "B301", "B324", "B701", "B201", "X999"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    return F.col(column).cast("string") if isinstance(column, str) else column.cast("string")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw analyser results from ``events``."""
    e = table(spark, sf_dir, "events")
    line = F.col("event_id") % 400 + 1
    return e.select(
        F.col("event_id").alias("finding_id"),
        F.element_at(F.array(*map(F.lit, TEST_IDS)), (F.col("event_id") % 8 + 1).cast("int")).alias("test_id"),
        F.concat(F.lit("found by "), "event_type").alias("issue_text"),
        line.cast("int").alias("line_number"),
        F.when(F.col("event_id") % 11 == 0, None)
        .when(F.col("value") < 5, "LOW")
        .when(F.col("value") < 20, "MEDIUM")
        .when(F.col("value") < 60, "HIGH")
        .when(F.col("value") < 200, "CRITICAL")
        .otherwise("UNDEFINED").alias("issue_severity"),
        F.when(F.col("event_type") == "purchase", "HIGH")
        .when(F.col("event_type").isin("click", "view"), "MEDIUM")
        .otherwise("LOW").alias("issue_confidence"),
        F.concat(
            text_of(line), F.lit("     x = load('"), "props", F.lit("')\n"),
            text_of(line + 1), F.lit("\n"), text_of(line + 2), F.lit("\trun(x, "), text_of(F.col("event_id") % 50), F.lit(")\n"),
        ).alias("code"),
        F.concat(
            F.lit("repo"), text_of(F.col("user_id") % 5),
            F.when(F.col("user_id") % 13 == 0, "/tests/m").otherwise("/src/m"), text_of("user_id"),
            F.when(F.col("user_id") % 17 == 0, ".json").otherwise(".py"),
        ).alias("filename"),
    )


SQL = {
    "results": """
    SELECT event_id AS finding_id,
      CASE event_id % 8 WHEN 0 THEN 'B105' WHEN 1 THEN 'B608' WHEN 2 THEN 'B602' WHEN 3 THEN 'B301'
        WHEN 4 THEN 'B324' WHEN 5 THEN 'B701' WHEN 6 THEN 'B201' ELSE 'X999' END AS test_id,
      'found by ' || event_type AS issue_text,
      CAST(event_id % 400 + 1 AS INTEGER) AS line_number,
      CASE WHEN event_id % 11 = 0 THEN NULL WHEN value < 5 THEN 'LOW' WHEN value < 20 THEN 'MEDIUM'
        WHEN value < 60 THEN 'HIGH' WHEN value < 200 THEN 'CRITICAL' ELSE 'UNDEFINED' END AS issue_severity,
      CASE WHEN event_type = 'purchase' THEN 'HIGH' WHEN event_type IN ('click', 'view') THEN 'MEDIUM' ELSE 'LOW' END AS issue_confidence,
      (event_id % 400 + 1) || '     x = load(''' || props || ''')' || chr(10) || (event_id % 400 + 2) || chr(10)
        || (event_id % 400 + 3) || chr(9) || 'run(x, ' || (event_id % 50) || ')' || chr(10) AS code,
      'repo' || (user_id % 5) || CASE WHEN user_id % 13 = 0 THEN '/tests/m' ELSE '/src/m' END || user_id
        || CASE WHEN user_id % 17 = 0 THEN '.json' ELSE '.py' END AS filename
    FROM events""",
    # Findings after classification, with levels lower-cased and the bad ones left out.
    "findings": """
    SELECT finding_id, test_id AS bandit_test_id, issue_text AS description, line_number AS line, filename AS file,
      CASE test_id WHEN 'B105' THEN 'Hardcoded Secret' WHEN 'B608' THEN 'SQL Injection' WHEN 'B602' THEN 'Command Injection'
        WHEN 'B301' THEN 'Insecure Deserialization' WHEN 'B324' THEN 'Weak Cryptography' WHEN 'B701' THEN 'Cross-Site Scripting'
        WHEN 'B201' THEN 'Insecure Configuration' ELSE 'Unknown Vulnerability' END AS type,
      lower(coalesce(issue_severity, 'low')) AS severity, lower(issue_confidence) AS confidence,
      trim(array_to_string(list_transform(string_split(code, chr(10)), lambda l: regexp_replace(l, '^\\d+\\s*', '')), chr(10)), ' ' || chr(10) || chr(9)) AS snippet
    FROM results WHERE coalesce(issue_severity, 'LOW') IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')""",
    "deps": """
    SELECT p_partkey AS dep_id, 'm' || (p_partkey % 20) AS file, 'pkg' || (p_partkey % 200) AS package,
      (p_size % 5) || '.' || (p_partkey % 13) || '.0' AS version FROM part""",
    "ranges": """
    SELECT 'ADV-' || s_suppkey AS vuln_id, 'PyPI' AS ecosystem, 'pkg' || (s_suppkey % 200) AS package,
      CASE WHEN s_suppkey % 4 = 0 THEN '1.0' ELSE '0' END AS introduced,
      CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 5) || '.' || (s_suppkey % 13) || '.0' END AS fixed,
      CASE WHEN s_suppkey % 9 = 0 AND s_suppkey % 2 = 0 THEN '3.5' END AS last_affected FROM supplier""",
    # DEP x RANGE on plain numbers: versions here are major.minor.0.
    "vulnerable": """
    SELECT d.dep_id, d.file, d.package, d.version, string_agg(DISTINCT r.vuln_id, ',' ORDER BY r.vuln_id) AS cves
    FROM (SELECT *, CAST(split_part(version, '.', 1) AS INT) * 1000 + CAST(split_part(version, '.', 2) AS INT) AS k FROM deps) d
    JOIN (SELECT *, CASE WHEN introduced = '0' THEN 0 ELSE 1000 END AS lo,
            CAST(split_part(fixed, '.', 1) AS INT) * 1000 + CAST(split_part(fixed, '.', 2) AS INT) AS hi,
            CASE WHEN last_affected IS NOT NULL THEN 3005 END AS la FROM ranges) r
      ON d.package = r.package AND k >= lo AND (hi IS NULL OR k < hi) AND (la IS NULL OR k <= la)
    GROUP BY ALL""",
    "chunks": """
    SELECT doc_id * 1000000 + i AS chunk_id, doc_id, i AS seq, lang, source, substr(text, (i - 1) * 700 + 1, 800) AS content
    FROM (SELECT *, unnest(range(1, 2 + (greatest(1, length(text) - 100) - 1) // 700)) AS i FROM documents WHERE length(text) > 0)""",
    "tf": """
    SELECT chunk_id, term, count(*) AS tf FROM (
      SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda t: t <> '')) AS term FROM chunks) GROUP BY ALL""",
    "lengths": "SELECT chunk_id, sum(tf) AS len FROM tf GROUP BY 1",
    "corpus": """
    SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(len) FROM lengths)::DOUBLE / (SELECT count(*) FROM chunks) AS avgdl""",
    "raw_idf": """
    SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), corpus""",
    "idf": """
    SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw_idf) ELSE idf END AS idf FROM raw_idf""",
    "gain": """
    SELECT term, chunk_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) AS gain
    FROM tf JOIN idf USING (term) JOIN lengths USING (chunk_id), corpus""",
    "queries": "SELECT item_id AS query_id, text FROM benchmark",
    "query_terms": """
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS term FROM queries) GROUP BY ALL""",
    "scores": """
    SELECT query_id, chunk_id, round(sum(qtf * gain), 6) AS score FROM query_terms JOIN gain USING (term) GROUP BY ALL""",
    "bm25": """
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM scores QUALIFY rank <= 2""",
    "vectors": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "cosines": """
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS query_label, b.label AS label,
      round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS score
    FROM vectors a, vectors b""",
    "nearest": """
    SELECT query_id, chunk_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM cosines QUALIFY rank <= 12""",
    "lines": """
    SELECT doc_id, i AS line_no, l[i] AS line, len(l) AS n FROM (
      SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    # Lines of source files: a final newline does not start another line.
    "file_lines": """
    SELECT path, i AS line_no, l[i] AS line, len(l) AS n FROM (
      SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS l FROM files))""",
    # Code-like texts: lines get an indent, some become def lines, comments or imports.
    "files": """
    SELECT 'd' || doc_id || '.py' AS path, string_agg(
      CASE WHEN line_no % 9 = 0 THEN repeat(' ', 4 * (line_no // 9 % 2)) || 'def f' || line_no || '():'
           WHEN line_no = 2 OR line_no = 5 THEN 'import m' || (doc_id % 7 + line_no)
           WHEN trim(line) = '' THEN ''
           ELSE repeat(' ', 4 * (line_no % 4)) || line END, chr(10) ORDER BY line_no) AS content
    FROM lines GROUP BY doc_id""",
    # One fix per non-blank line, aimed three lines off; some snippets are altered.
    "fixes": """
    SELECT CAST(substr(path, 2, length(path) - 4) AS BIGINT) * 1000000 + line_no AS fix_id, path, line_no + 3 AS line,
      CASE WHEN line_no % 5 = 2 THEN replace(line, 'e', 'E') || ' ;' WHEN line_no % 7 = 3 THEN line || '  # x' ELSE line END AS snippet,
      'import m' || (line_no % 11) || chr(10) || 'pass' AS suggested_fix
    FROM file_lines WHERE trim(line) <> ''""",
    "responses": """
    SELECT conv_id * 1000 + turn AS finding_id, conv_id, turn,
      CASE WHEN turn % 4 = 3 AND conv_id % 6 = 1 THEN 'no json here'
        ELSE CASE WHEN conv_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END
          || CASE WHEN conv_id % 5 = 0 THEN '[' ELSE '' END
          || '{"suggested_fix": ' || CAST(to_json(left_text) AS VARCHAR) || ', "explanation": ' || CAST(to_json(text) AS VARCHAR)
          || CASE WHEN turn % 3 = 0 THEN ', "confidence": "High"' ELSE '' END || '}'
          || CASE WHEN conv_id % 5 = 0 THEN ']' ELSE '' END
          || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS answer
    FROM (SELECT *, 'fix ' || conv_id || chr(10) || '  "' || role || '"' AS left_text FROM conversations)""",
}


NEEDS = {
    "findings": ["results"],
    "vulnerable": ["deps", "ranges"],
    "tf": ["chunks"],
    "lengths": ["tf"],
    "corpus": ["chunks", "lengths"],
    "raw_idf": ["tf", "corpus"],
    "idf": ["raw_idf"],
    "gain": ["tf", "idf", "lengths", "corpus"],
    "query_terms": ["queries"],
    "scores": ["query_terms", "gain"],
    "bm25": ["scores"],
    "cosines": ["vectors"],
    "nearest": ["cosines"],
    "files": ["lines"],
    "file_lines": ["files"],
    "fixes": ["file_lines"],
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the common tables it needs, with all they build on."""
    order: list[str] = []

    def need(name: str) -> None:
        for below in NEEDS.get(name, []):
            need(below)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return body.strip()
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n].strip()})" for n in order)
    return f"WITH {clauses}\n{body.strip()}"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified findings with valid levels and clean snippets."""
    good, _ = normalise_levels(classify(results(spark, sf_dir)))
    return good.select(
        "finding_id",
        F.col("test_id").alias("bandit_test_id"),
        F.col("issue_text").alias("description"),
        F.col("line_number").alias("line"),
        F.col("filename").alias("file"),
        "type", "severity", "confidence",
        clean_snippet(F.col("code")).alias("snippet"),
    )


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("dep_id"),
        F.concat(F.lit("m"), text_of(F.col("p_partkey") % 20)).alias("file"),
        F.concat(F.lit("pkg"), text_of(F.col("p_partkey") % 200)).alias("package"),
        F.concat(text_of(F.col("p_size") % 5), F.lit("."), text_of(F.col("p_partkey") % 13), F.lit(".0")).alias("version"),
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("ADV-"), text_of(key)).alias("vuln_id"),
        F.lit("PyPI").alias("ecosystem"),
        F.concat(F.lit("pkg"), text_of(key % 200)).alias("package"),
        F.when(key % 4 == 0, "1.0").otherwise("0").alias("introduced"),
        F.when(key % 9 != 0, F.concat(text_of(key % 5), F.lit("."), text_of(key % 13), F.lit(".0"))).alias("fixed"),
        F.when((key % 9 == 0) & (key % 2 == 0), "3.5").alias("last_affected"),
    )


def vulnerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_advisories(deps(spark, sf_dir), ranges(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("content"))
    cut = chunk_window(docs)
    return cut.withColumn("chunk_id", F.col("doc_id") * 1000000 + F.col("seq"))


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The chunks' index, written at its first use in a session and opened at each."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/vulnlake/stored-index-{uuid.uuid4().hex}"
        rows = chunks(spark, sf_dir).withColumnRenamed("lang", "doc_type")
        write_index(rows.withColumn("embedding", embed_hashed(F.col("content"))), path)
        _STORED[key] = path
    return open_index(spark, _STORED[key])


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def coded(line: Column, i: Column) -> Column:
        no = i + 1
        blanks = lambda n: F.repeat(F.lit(" "), (n * 4).cast("int"))
        return (
            F.when(no % 9 == 0, F.concat(blanks(F.floor(no / 9) % 2), F.lit("def f"), text_of(no), F.lit("():")))
            .when((no == 2) | (no == 5), F.concat(F.lit("import m"), text_of(F.col("doc_id") % 7 + no)))
            .when(F.trim(line) == "", "")
            .otherwise(F.concat(blanks(no % 4), line))
        )

    return docs.select(
        F.concat(F.lit("d"), text_of("doc_id"), F.lit(".py")).alias("path"),
        F.array_join(F.transform(F.split("text", "\n"), coded), "\n").alias("content"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    doc = F.expr("cast(substring(path, 2, length(path) - 4) as bigint)")
    no = F.col("i") + 1
    return (
        files(spark, sf_dir)
        .select("path", F.posexplode(lines).alias("i", "text"))
        .where(F.trim("text") != "")
        .select(
            (doc * 1000000 + no).alias("fix_id"),
            "path",
            (no + 3).alias("line"),
            F.when(no % 5 == 2, F.concat(F.replace("text", F.lit("e"), F.lit("E")), F.lit(" ;")))
            .when(no % 7 == 3, F.concat("text", F.lit("  # x")))
            .otherwise(F.col("text")).alias("snippet"),
            F.concat(F.lit("import m"), text_of(no % 11), F.lit("\npass")).alias("suggested_fix"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    left = F.concat(F.lit("fix "), text_of("conv_id"), F.lit('\n  "'), "role", F.lit('"'))
    when = lambda test, text: F.when(test, text).otherwise("")
    even, five = F.col("conv_id") % 2 == 0, F.col("conv_id") % 5 == 0
    answer = F.concat(
        when(even, "```json\n"), when(five, "["),
        F.lit('{"suggested_fix": '), quoted(left), F.lit(', "explanation": '), quoted(F.col("text")),
        when(F.col("turn") % 3 == 0, ', "confidence": "High"'), F.lit("}"),
        when(five, "]"), when(even, "\n```"),
    )
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("finding_id"), "conv_id", "turn",
        F.when((F.col("turn") % 4 == 3) & (F.col("conv_id") % 6 == 1), "no json here").otherwise(answer).alias("answer"),
    )
