"""From analyser results and manifests to a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vulnlake.operators.dependencies import match_advisories, unmatched
from vulnlake.operators.findings import common_root, exclude, map_results, min_level, scan_summary
from vulnlake.session import stage


@dataclass(frozen=True)
class ScanResult:
    findings: DataFrame
    dependencies: DataFrame
    quarantine: DataFrame
    summary: DataFrame
    root: DataFrame
    unmatched: DataFrame


def scan(
    results: DataFrame,
    dependencies: DataFrame | None = None,
    ranges: DataFrame | None = None,
    severity: str = "medium",
    confidence: str = "medium",
    skip_ids: Sequence[str] = (),
    exclude_paths: Sequence[str] = (),
) -> ScanResult:
    """Classify, clean and filter results; match pinned dependencies; summarise.

    ``results`` comes from ``read_scanner_output``, ``dependencies`` from
    ``read_manifests`` and ``ranges`` from ``read_advisories``. Write the outcome with
    ``write_report``. Pins and ranges that cannot be ordered are rows of ``unmatched``. Both lists
    are staged, as summary, root and report read them.
    """
    kept = exclude(results, skip_ids, exclude_paths, file="filename")
    mapped, quarantine = map_results(kept)
    findings = stage(min_level(mapped, severity, confidence), "scan-findings")
    spark = results.sparkSession
    if dependencies is not None and ranges is not None:
        vulnerable = stage(match_advisories(dependencies, ranges).select("package", "version", "cves", "file"), "scan-dependencies")
        left_out = unmatched(dependencies, ranges)
    else:
        left_out = spark.createDataFrame([], "kind string, package string, text string, error string")
        vulnerable = spark.createDataFrame([], "package string, version string, cves array<string>, file string")
    return ScanResult(findings, vulnerable, quarantine, scan_summary(findings, vulnerable), common_root(findings), left_out)
