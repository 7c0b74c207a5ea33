"""Documents: P1-P3, P17, W1, W2, F7, T1, T2, U2, A13, A16, C2."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.functions import text as tx
from vulnlake.operators import corpus as cp
from vulnlake.plans.ingest import ingest
from vulnlake.sources.corpus import read_advisories


@query("""
SELECT doc_id, md5('CWE-' || CASE WHEN doc_id % 10 = 3 THEN 'Unknown' ELSE CAST(doc_id AS VARCHAR) END || ': ' || source || repeat(chr(10), 2) || 'Description: ' || lang
  || repeat(chr(10), 2) || CASE WHEN doc_id % 3 = 1 THEN 'Extended Description: ' || text || repeat(chr(10), 2) ELSE '' END
  || CASE WHEN doc_id % 4 = 1 THEN 'Mitigations:' || chr(10) || lang ELSE '' END) AS digest FROM documents""")
def render_weakness(spark, d):
    t = v.table(spark, d, "documents")
    i = F.col("doc_id")
    rows = t.select(
        "doc_id",
        F.when(i % 10 != 3, v.text_of("doc_id")).alias("cwe_id"),
        F.col("source").alias("name"),
        F.col("lang").alias("description"),
        F.when(i % 3 == 1, F.col("text")).when(i % 3 == 2, "").alias("extended_description"),
        F.when(i % 4 == 1, F.col("lang")).alias("mitigations"),
    )
    return cp.render_weakness(rows).select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


ALIASES = "CASE WHEN s_suppkey % 3 = 0 THEN 'GHSA-' || s_suppkey || ', CVE-' || s_suppkey || ', CVE-X' WHEN s_suppkey % 3 = 1 THEN 'PYSEC-' || s_suppkey ELSE '' END"


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'CVE-' || s_suppkey || ', CVE-X' ELSE '' END AS cve_ids, {ALIASES} AS aliases FROM supplier""")
def cve_aliases(spark, d):
    s = v.table(spark, d, "supplier")
    key = v.text_of("s_suppkey")
    aliases = (
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat(F.lit("GHSA-"), key), F.concat(F.lit("CVE-"), key), F.lit("CVE-X")))
        .when(F.col("s_suppkey") % 3 == 1, F.array(F.concat(F.lit("PYSEC-"), key)))
        .otherwise(F.array().cast("array<string>"))
    )
    return s.select("s_suppkey", tx.cve_aliases(aliases).alias("cve_ids"), F.array_join(aliases, ", ").alias("aliases"))


def advisory_files(spark, d):
    """One YAML advisory per supplier; every seventh is not valid YAML."""
    s = v.table(spark, d, "supplier")
    key = v.text_of("s_suppkey")
    body = F.concat(
        F.lit("id: ADV-"), key, F.lit("\ndetails: |\n  about "), F.col("s_name"),
        F.lit("\naffected:\n- package: {name: pkg"), v.text_of(F.col("s_suppkey") % 200),
        F.lit(", ecosystem: PyPI}\n  ranges:\n  - type: ECOSYSTEM\n    events:\n    - introduced: '0'\n"),
        F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.lit("    - fixed: '"), v.text_of(F.col("s_suppkey") % 5), F.lit(".0.0'\n    - introduced: '8.0'\n"))).otherwise(""),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("references:\n- {type: WEB, url: 'http://x/"), key, F.lit("'}\n- {url: y}\n"))).otherwise(""),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("aliases: [CVE-"), key, F.lit("]\n"))).otherwise(""),
    )
    text = F.when(F.col("s_suppkey") % 7 == 5, F.lit("id: [unclosed")).otherwise(body)
    return s.select(F.concat(F.lit("a"), key, F.lit(".yaml")).alias("path"), text.cast("binary").alias("content"))


@query("""
SELECT 'a' || s_suppkey || '.yaml' AS source, 'ADV-' || s_suppkey AS vulnerability_id, CASE WHEN s_suppkey % 3 = 0 THEN 'CVE-' || s_suppkey ELSE '' END AS cve_ids,
  'Vulnerability ID: ADV-' || s_suppkey || repeat(chr(10), 2) || 'Details: about ' || s_name || repeat(chr(10), 3)
  || 'Affected Packages:' || chr(10) || '  - pkg' || (s_suppkey % 200) || ' (PyPI)' || chr(10) || '    - introduced: 0' || chr(10)
  || CASE WHEN s_suppkey % 9 <> 0 THEN '    - fixed: ' || (s_suppkey % 5) || '.0.0' || chr(10) || '    - introduced: 8.0' || chr(10) ELSE '' END
  || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'References:' || chr(10) || '  - [WEB] http://x/' || s_suppkey || chr(10) || '  - [LINK] y' || chr(10) ELSE '' END AS content
FROM supplier WHERE s_suppkey % 7 <> 5""")
def render_advisory(spark, d):
    return read_advisories(advisory_files(spark, d))[0].select("source", "vulnerability_id", "cve_ids", "content")


@query("""
SELECT 'ADV-' || s_suppkey AS vuln_id, 'pkg' || (s_suppkey % 200) AS package, '0' AS introduced,
  CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 5) || '.0.0' ELSE '' END AS fixed FROM supplier WHERE s_suppkey % 7 <> 5
UNION ALL SELECT 'ADV-' || s_suppkey, 'pkg' || (s_suppkey % 200), '8.0', '' FROM supplier WHERE s_suppkey % 7 <> 5 AND s_suppkey % 9 <> 0""")
def advisory_ranges(spark, d):
    ranges = read_advisories(advisory_files(spark, d))[1]
    return ranges.select("vuln_id", "package", "introduced", F.coalesce("fixed", F.lit("")).alias("fixed"))


@query("""SELECT 'a' || s_suppkey || '.yaml' AS file_name, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 5) AS failed_total
FROM supplier WHERE s_suppkey % 7 = 5""")
def failed_files(spark, d):
    return cp.failed_summary(read_advisories(advisory_files(spark, d))[2]).select("file_name", "failed_total")


@query("""
SELECT page_id, array_to_string(list_transform(regexp_extract_all('page_' || regexp_replace(split_part(url, '/', 3), '\\.[^.]*$', ''), '[A-Za-z]+|[^A-Za-z]+'),
  lambda r: upper(substr(replace(r, '_', ' '), 1, 1)) || lower(substr(replace(r, '_', ' '), 2))), '') AS title FROM pages""")
def guide_title(spark, d):
    host = F.split("url", "/")[2]
    path = F.concat(F.lit("/guides/page_"), host)
    return v.table(spark, d, "pages").select("page_id", tx.guide_title(path).alias("title"))


def guides(spark, d):
    """Documents with headings of three levels and code fences put on some lines."""
    def marked(line, i):
        no = i + 1
        return (
            F.when(no % 11 == 0, "```")
            .when(no % 7 == 0, F.concat(F.lit("# "), line))
            .when(no % 5 == 0, F.concat(F.lit("## "), line))
            .when(no % 3 == 0, F.concat(F.lit("### "), line))
            .otherwise(line)
        )

    return v.table(spark, d, "documents").select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n"), marked), "\n").alias("text")
    )


MARKED = """
md AS (SELECT doc_id, line_no, CASE WHEN line_no % 11 = 0 THEN '```' WHEN line_no % 7 = 0 THEN '# ' || line WHEN line_no % 5 = 0 THEN '## ' || line
  WHEN line_no % 3 = 0 THEN '### ' || line ELSE line END AS line FROM lines),
fenced AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS inside FROM md),
leveled AS (SELECT *, CASE WHEN inside THEN 0 WHEN line LIKE '# %' THEN 1 WHEN line LIKE '## %' THEN 2 WHEN line LIKE '### %' THEN 3 ELSE 0 END AS level FROM fenced),
lasts AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS n1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS n2,
    max(CASE WHEN level = 3 THEN line_no END) OVER w AS n3, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS section
  FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
live AS (SELECT doc_id, line_no, line, section, n1, CASE WHEN n2 > coalesce(n1, 0) THEN n2 END AS n2,
    CASE WHEN n3 > greatest(coalesce(n1, 0), coalesce(n2, 0)) THEN n3 END AS n3 FROM lasts),
paths AS (SELECT l.doc_id, l.line_no, l.line, l.section, coalesce(trim(substr(a.line, 3)), '') AS h1, coalesce(trim(substr(b.line, 4)), '') AS h2,
    coalesce(trim(substr(c.line, 5)), '') AS h3 FROM live l LEFT JOIN md a ON a.doc_id = l.doc_id AND a.line_no = n1
  LEFT JOIN md b ON b.doc_id = l.doc_id AND b.line_no = n2 LEFT JOIN md c ON c.doc_id = l.doc_id AND c.line_no = n3)"""


@query("WITH lines AS (" + v.SQL["lines"] + ")," + MARKED + " SELECT doc_id, line_no, h1, h2, h3, md5(line) AS digest FROM paths")
def header_path(spark, d):
    empty = F.lit("")
    rows = cp.header_path(guides(spark, d), "doc_id", "text")
    return rows.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), *[F.coalesce(h, empty).alias(h) for h in ("h1", "h2", "h3")],
        F.md5(F.col("line").cast("binary")).alias("digest"),
    )


@query("WITH lines AS (" + v.SQL["lines"] + ")," + MARKED + """
SELECT doc_id, min(line_no) AS seq, min(h1) AS h1, min(h2) AS h2, min(h3) AS h3, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest
FROM paths GROUP BY doc_id, section HAVING trim(replace(string_agg(line, ''), chr(10), '')) <> ''""")
def sections(spark, d):
    empty = F.lit("")
    rows = cp.sections(guides(spark, d), "doc_id", "text")
    return rows.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), *[F.coalesce(h, empty).alias(h) for h in ("h1", "h2", "h3")],
        F.md5(F.col("content").cast("binary")).alias("digest"),
    )


def labelled(spark, d):
    """Documents, flagged as chunks already where their label says good quality."""
    docs, labels = v.table(spark, d, "documents"), v.table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", F.col("lang").alias("doc_type"), F.col("text").alias("content"), (F.col("quality") == 1).alias("pre_chunked")
    )


@query("""
SELECT d.doc_id, CASE WHEN coalesce(quality = 1, false) THEN 'ready' ELSE 'split' END AS part FROM documents d LEFT JOIN labels l USING (doc_id)""")
def needs_splitting(spark, d):
    ready, rest = cp.needs_splitting(labelled(spark, d))
    return ready.select("doc_id", F.lit("ready").alias("part")).union(rest.select("doc_id", F.lit("split").alias("part")))


@query(sql("SELECT chunk_id, doc_id, seq, content FROM chunks", "chunks"))
def chunk_window(spark, d):
    return v.chunks(spark, d).select("chunk_id", "doc_id", F.col("seq").cast("bigint").alias("seq"), "content")


# The splitter: texts that are not done are cut at their coarsest separator. A fold over the parts gives finished pieces and
# parts that are too long, which the next step cuts by the finer separators; places keep the order.
SEPS = "[repeat(chr(10), 2), chr(10), ' ', '']"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
GIVEN = f"list_filter([{{'t': trim(array_to_string(x.win, ''), {SPACES}), 'done': true, 'level': 0}}], lambda g: g.t <> '')"
KEEPS = "x.win[list_filter(range(1, len(x.win) + 2), lambda j: coalesce(list_sum(list_transform(x.win[j:], lambda p: length(p))), 0) <= least(100, 800 - e.held))[1]:]"
SPLIT = f"""cut AS (
  SELECT doc_id, CASE WHEN pre THEN [0] ELSE []::INTEGER[] END AS place, content AS t, 0 AS level, content IS NULL OR content = '' OR pre AS done, 0 AS turn FROM split_these
  UNION ALL
  SELECT doc_id, list_append(place, i::INTEGER), g.t, g.level, g.done, turn + 1 FROM (
    SELECT doc_id, place, turn, unnest(gs) AS g, unnest(range(1, len(gs) + 1)) AS i FROM (
      SELECT doc_id, place, turn, CASE WHEN level = 3
        THEN list_filter(list_transform(range(0, greatest(length(t) - 100, 1), 700), lambda s: {{'t': trim(substr(t, (s + 1)::BIGINT, 800), {SPACES}), 'done': true, 'level': 0}}), lambda g: g.t <> '')
        ELSE list_concat(x.o, {GIVEN}) END AS gs
      FROM (SELECT *, list_reduce(list_prepend({{'o': []::STRUCT(t VARCHAR, done BOOLEAN, level INTEGER)[], 'win': []::VARCHAR[], 'held': 0::BIGINT}},
          list_transform(parts, lambda p: {{'o': []::STRUCT(t VARCHAR, done BOOLEAN, level INTEGER)[], 'win': [p], 'held': length(p)}})),
          lambda x, e: CASE
            WHEN e.held >= 800 THEN {{'o': list_concat(x.o, {GIVEN}, [{{'t': e.win[1], 'done': false, 'level': level + 1}}]), 'win': []::VARCHAR[], 'held': 0::BIGINT}}
            WHEN x.held + e.held > 800 THEN {{'o': list_concat(x.o, {GIVEN}), 'win': list_concat({KEEPS}, e.win),
              'held': (coalesce(list_sum(list_transform({KEEPS}, lambda p: length(p))), 0) + e.held)::BIGINT}}
            ELSE {{'o': x.o, 'win': list_concat(x.win, e.win), 'held': x.held + e.held}} END) AS x
        FROM (SELECT doc_id, place, t, level, turn, list_filter(list_transform(string_split(t, {SEPS}[level + 1]), lambda p, i: CASE WHEN i > 1 THEN {SEPS}[level + 1] || p ELSE p END), lambda p: p <> '') AS parts
          FROM (SELECT doc_id, place, t, turn, list_filter(range(0, 4), lambda l: l >= level AND (l = 3 OR contains(t, {SEPS}[l + 1])))[1]::INTEGER AS level FROM cut WHERE NOT done)))))),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS seq, t AS content, len(place) = 1 AND place = [0] AS pre FROM cut WHERE done AND coalesce(t, '') <> '')"""


@query(f"WITH RECURSIVE split_these AS (SELECT doc_id, text AS content, false AS pre FROM documents), {SPLIT} SELECT doc_id, seq, md5(content) AS digest FROM pieces")
def chunk_recursive(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return cp.chunk_recursive(docs).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(sql("""
SELECT doc_id, 0 AS seq, md5(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 1
UNION ALL SELECT doc_id, seq, md5(content) FROM chunks LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) <> 1""", "chunks"))
def union_chunks(spark, d):
    ready, rest = cp.needs_splitting(labelled(spark, d))
    both = cp.union_chunks(ready, cp.chunk_window(rest))
    return both.select(
        "doc_id", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.md5(F.col("content").cast("binary")).alias("digest")
    )


@query(sql("""
SELECT coalesce(lang, '*') AS doc_type, coalesce(source, '*') AS source, CAST(grouping(lang, source) AS INTEGER) AS level, count(*) AS chunks,
  round(avg(length(content)), 6) AS mean_length FROM chunks GROUP BY ROLLUP (lang, source)""", "chunks"))
def index_stats(spark, d):
    stats = cp.index_stats(v.chunks(spark, d).withColumnRenamed("lang", "doc_type"))
    every = F.lit("*")
    return stats.select(
        F.coalesce("doc_type", every).alias("doc_type"), F.coalesce("source", every).alias("source"),
        "level", "chunks", F.round("mean_length", 6).alias("mean_length"),
    )


BUCKET = "list_transform(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda t: t <> ''), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64)"


@query(f"""
WITH RECURSIVE split_these AS (SELECT doc_id, text AS content, coalesce(quality = 1, false) AS pre FROM documents LEFT JOIN labels USING (doc_id)), {SPLIT}
SELECT p.doc_id, d.source, d.lang AS doc_type, md5(content) AS digest, list_sum(list_transform({BUCKET}, lambda b: b * b))::BIGINT AS buckets
FROM pieces p JOIN documents d USING (doc_id)""")
def ingest_corpus(spark, d):
    """Chunks of every document with their vectors: ready ones as they are, the others split."""
    squares = F.aggregate(F.transform("embedding", lambda n, i: n.cast("bigint") * i * i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ingest(labelled(spark, d)).select("doc_id", "source", "doc_type", F.md5(F.col("content").cast("binary")).alias("digest"), squares.alias("buckets"))
