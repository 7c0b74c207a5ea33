"""Analyser output, saved reports and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators.findings import union_findings
from vulnlake.operators.locating import source_lines
from vulnlake.sources.corpus import plain_path, scan_files
from vulnlake.sources.schemas import CODE_FINDING, DEPENDENCY_FINDING, REPORT, SCANNER_OUTPUT


def _read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Files with one JSON document each -> (good rows, ``path, error`` of the unreadable)."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    raw = spark.read.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.from_json("value", f"{schema}, _corrupt string", options).alias("_json"),
    )
    broken = F.col("_json._corrupt").isNotNull()
    bad = raw.where(broken).select("path", F.lit("invalid JSON").alias("error"))
    return raw.where(~broken).select("path", "_json.*").drop("_corrupt"), bad


def read_scanner_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Analyser JSON files -> (raw results, failed files)."""
    good, bad = _read_json(spark, path, SCANNER_OUTPUT)
    return good.select(F.explode("results").alias("_r")).select("_r.*"), bad


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Saved nested reports -> (findings with ``origin``, failed files)."""
    good, bad = _read_json(spark, path, REPORT)
    code = good.select("path", "repository_root", F.explode("sast_findings").alias("_f"))
    deps = good.select("path", "repository_root", F.explode("cve_findings").alias("_f"))
    columns = [F.col("path").alias("report"), "repository_root", "_f.*"]
    return union_findings(code.select(*columns), deps.select(*columns)), bad


def read_report_tables(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a report in the table layout that ``write_report`` produces."""
    code = spark.read.schema(CODE_FINDING).json(f"{path}/sast_findings")
    deps = spark.read.schema(DEPENDENCY_FINDING).json(f"{path}/cve_findings")
    return union_findings(code, deps)


def read_source_files(
    spark: SparkSession, root: str, wanted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Code files below ``root`` as ``path, content``, and the failed ones (``path, error``).

    ``wanted`` (column ``path``) restricts the files; paths it lists that do not exist
    are failed. So is a file that is not UTF-8: patching a guessed text would damage it.
    Line ends become ``\\n``; a byte order mark is dropped.
    """
    text = F.col("content").cast("string")
    files = scan_files(spark, root).select("path", "content").withColumn("_utf8", F.is_valid_utf8(text))
    unreadable = files.where(~F.col("_utf8")).select("path", F.lit("not UTF-8").alias("error"))
    clean = F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\r\n?", "\n")
    readable = files.where("_utf8").select("path", clean.alias("content"))
    if wanted is None:
        return readable, unreadable
    paths = wanted.select("path").distinct()
    missing = paths.join(files.select("path"), "path", "left_anti").withColumn("error", F.lit("File not found"))
    failed = missing.unionByName(unreadable.join(paths, "path", "left_semi"))
    return readable.join(paths, "path", "left_semi"), failed


def code_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, text`` of source files."""
    return files.select("path", F.posexplode(source_lines(F.col("content"))).alias("_i", "text")).select(
        "path", (F.col("_i") + 1).alias("line_no"), "text"
    )
