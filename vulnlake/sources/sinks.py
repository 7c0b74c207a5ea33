"""Report, remediation and change-set writers.

A report is a folder of JSON tables (``summary`` with one row, one table per list), so
that no task ever holds a whole report. JSON rows leave out null fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.findings import scan_summary
from vulnlake.operators.patching import relative_paths


def report_summary(findings: DataFrame, dependencies: DataFrame, root: str | None = None) -> DataFrame:
    counts = scan_summary(findings, dependencies)
    return counts.select(
        "total_findings",
        "total_cve_findings",
        F.struct("low", "medium", "high", "critical").alias("by_severity"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scan_timestamp"),
        F.lit(root).cast("string").alias("repository_root"),
    )


def write_report(findings: DataFrame, dependencies: DataFrame, path: str, root: str | None = None) -> None:
    """``summary``, ``sast_findings`` and ``cve_findings`` below ``path``."""
    report_summary(findings, dependencies, root).write.mode("overwrite").json(f"{path}/summary")
    findings.write.mode("overwrite").json(f"{path}/sast_findings")
    dependencies.write.mode("overwrite").json(f"{path}/cve_findings")


def write_remediations(remediations: DataFrame, summary: DataFrame, path: str) -> None:
    """``summary`` and ``remediations`` below ``path``."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    remediations.write.mode("overwrite").json(f"{path}/remediations")


def changed_files(patched: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Patch results -> (changed files by relative path, failed files).

    ``patched`` comes from ``patch_files``; stage it, as both results read it.
    """
    done = patched.where(F.col("kind") == "file").select("path", "content", "n_applied", "n_failed")
    inside, outside = relative_paths(done, root)
    changed = inside.select("relative_path", "content", "n_applied", "n_failed")
    missing = patched.where(F.col("kind") == "missing").select("path", "error")
    return changed, missing.unionByName(outside.select("path", "error"))


def write_changed_files(patched: DataFrame, root: str, path: str) -> None:
    """``changed`` and ``failed`` tables below ``path``."""
    changed, failed = changed_files(patched, root)
    changed.write.mode("overwrite").parquet(f"{path}/changed")
    failed.write.mode("overwrite").json(f"{path}/failed")
