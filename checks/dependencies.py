"""Dependencies: S7-S9, P8, P9, T10, J1, F8."""

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import query
from checks.views import sql
from vulnlake.functions.text import decode_text as decode
from vulnlake.functions.text import parse_requirement
from vulnlake.functions.versions import version_key as key_of
from vulnlake.operators import dependencies as dp
from vulnlake.sources.manifests import read_projects


def specs(spark, d):
    p = v.deps(spark, d)
    pkg, ver, kind = F.col("package"), F.col("version"), F.col("dep_id") % 7
    spec = (
        F.when(kind == 0, F.concat(pkg, F.lit("=="), ver))
        .when(kind == 1, F.concat(pkg, F.lit(">="), ver, F.lit(",<9")))
        .when(kind == 2, pkg)
        .when(kind == 3, F.concat(pkg, F.lit("[a,b] < "), ver, F.lit(' ; python_version < "4"')))
        .when(kind == 4, F.concat(pkg, F.lit("~="), ver))
        .when(kind == 5, F.concat(pkg, F.lit(" >=0.1, =="), ver, F.lit(",<9")))
        .otherwise(F.concat(pkg, F.lit(" >> "), ver))
    )
    return p.select("dep_id", spec.alias("spec"))


@query(sql("""
SELECT dep_id, CASE WHEN dep_id % 7 IN (2, 6) THEN '' ELSE package END AS name,
  CASE dep_id % 7 WHEN 0 THEN '==' || version WHEN 1 THEN '>=' || version || ' <9' WHEN 3 THEN '<' || version WHEN 4 THEN '~=' || version
    WHEN 5 THEN '>=0.1 ==' || version || ' <9' ELSE '' END AS specs FROM deps""", "deps"))
def parse_requirement_spec(spark, d):
    req = specs(spark, d).withColumn("r", parse_requirement(F.col("spec")))
    joined = F.array_join(F.transform("r.specs", lambda s: F.concat(s["op"], s["version"])), " ")
    empty = F.lit("")
    return req.select("dep_id", F.coalesce("r.name", empty).alias("name"), F.coalesce(joined, empty).alias("specs"))


@query(sql("""
SELECT dep_id, CASE WHEN dep_id % 7 IN (2, 6) THEN '' ELSE package END AS package,
  CASE WHEN dep_id % 7 IN (0, 1, 3, 5) THEN version ELSE '' END AS version FROM deps""", "deps"))
def pick_version(spark, d):
    empty = F.lit("")
    return dp.parse_specs(specs(spark, d)).select(
        "dep_id", F.coalesce("package", empty).alias("package"), F.coalesce("version", empty).alias("version")
    )


@query(sql("""
SELECT dep_id, CASE kind WHEN 0 THEN version WHEN 1 THEN version || '.0.0.0.0.0.0.0.1' WHEN 2 THEN version || '.20230101120000' WHEN 3 THEN version || 'rc2'
    WHEN 4 THEN version || '.post202301011200' WHEN 5 THEN version || '.dev202301011200' ELSE version || '.99999999999999999999' END AS version,
  CASE WHEN kind < 6 THEN rank() OVER (PARTITION BY package, kind < 6 ORDER BY a, b, CASE kind WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 WHEN 4 THEN 3 WHEN 1 THEN 4 ELSE 5 END) END AS place
FROM (SELECT *, dep_id % 7 AS kind, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b FROM deps)""", "deps"))
def version_key(spark, d):
    from pyspark.sql import Window as W

    more = ["", ".0.0.0.0.0.0.0.1", ".20230101120000", "rc2", ".post202301011200", ".dev202301011200", ".99999999999999999999"]
    text = F.concat("version", F.array(*map(F.lit, more))[(F.col("dep_id") % 7).cast("int")])
    keyed = v.deps(spark, d).withColumn("version", text).withColumn("k", key_of(F.col("version")))
    place = F.rank().over(W.partitionBy("package", F.col("k").isNull()).orderBy("k")).cast("bigint")
    return keyed.select("dep_id", "version", F.when(F.col("k").isNotNull(), place).alias("place"))


def requirement_files(spark, d):
    """Text manifests of fifty lines each: pins, comments, bounds, doubled pins."""
    p = v.deps(spark, d)
    pkg, ver, kind = F.col("package"), F.col("version"), F.col("dep_id") % 10
    line = (
        F.when(kind == 3, F.concat(F.lit("# "), pkg))
        .when(kind == 5, F.concat(pkg, F.lit(">="), ver))
        .when(kind == 7, F.concat(pkg, F.lit("=="), ver, F.lit("==x")))
        .otherwise(F.concat(F.lit("  "), pkg, F.lit(" =="), ver, F.lit(" ")))
    )
    number = F.floor(F.col("dep_id") / 50)
    return (
        p.select(F.concat(F.lit("r"), v.text_of(number)).alias("file"), F.struct("dep_id", line.alias("line")).alias("l"))
        .groupBy("file")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\r\n").alias("content"))
    )


@query(sql("SELECT 'r' || (dep_id // 50) AS file, package, version FROM deps WHERE dep_id % 10 NOT IN (3, 5, 7)", "deps"))
def parse_requirements(spark, d):
    return dp.parse_requirements(requirement_files(spark, d))[0]


@query(sql("""
SELECT 'r' || (dep_id // 50) AS file, dep_id % 50 + 1 AS line, 'more than one == in: ' || package || '==' || version || '==x' AS error
FROM deps WHERE dep_id % 10 = 7""", "deps"))
def requirements_quarantine(spark, d):
    return dp.parse_requirements(requirement_files(spark, d))[1].withColumn("line", F.col("line").cast("bigint"))


@query(sql("""
SELECT 't' || (dep_id // 50) AS file, package, version FROM deps WHERE dep_id % 7 IN (0, 1, 3, 5) AND dep_id // 50 % 9 <> 4""", "deps"))
def project_dependencies(spark, d):
    number = F.floor(F.col("dep_id") / 50)
    quoted = specs(spark, d).withColumn("spec", F.concat(F.lit("'"), "spec", F.lit("'")))
    head = F.when(F.col("n") % 9 == 4, "[project\n").otherwise("[project]\nname = 'x'\n")
    files = (
        quoted.select(number.alias("n"), "spec")
        .groupBy("n")
        .agg(F.array_join(F.collect_list("spec"), ",\n").alias("body"))
        .select(
            F.concat(F.lit("t"), v.text_of("n")).alias("path"),
            F.concat(head, F.lit("dependencies = [\n"), "body", F.lit("\n]\n")).cast("binary").alias("content"),
        )
    )
    return read_projects(files)[0]


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_text(spark, d):
    docs = v.table(spark, d, "documents")
    kind = F.col("doc_id") % 3
    raw = (
        F.when(kind == 0, F.encode("text", "UTF-8"))
        .when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .otherwise(F.encode("text", "UTF-16"))
    )
    return docs.select("doc_id", F.md5(decode(raw).cast("binary")).alias("digest"))


@query(sql("SELECT * FROM vulnerable", "vulnerable"))
def match_advisories(spark, d):
    return v.vulnerable(spark, d).withColumn("cves", F.array_join("cves", ","))


@query(sql("SELECT file, count(*) AS vulnerable, sum(len(string_split(cves, ',')))::BIGINT AS advisories FROM vulnerable GROUP BY file", "vulnerable"))
def matched_only(spark, d):
    return v.vulnerable(spark, d).groupBy("file").agg(
        F.count("*").alias("vulnerable"), F.sum(F.size("cves")).alias("advisories")
    )
