"""Approved fixes -> patched files, headline, label and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import changes as ch
from vulnlake.operators.patching import patch_files
from vulnlake.session import stage
from vulnlake.sources.sinks import changed_files


@dataclass(frozen=True)
class ChangeSet:
    changed_files: DataFrame
    failed_files: DataFrame
    failed_fixes: DataFrame
    headline: DataFrame
    label: DataFrame
    report: DataFrame


def prepare_changes(
    remediations: DataFrame, files: DataFrame, root: str, timestamp: Column | None = None
) -> ChangeSet:
    """Patch every file with its change-worthy fixes and describe the change.

    ``remediations`` holds ``fix_id, type, file, line, severity, confidence, snippet,
    suggested_fix, explanation, cwe_id, source_documents``; ``files`` ``path, content``.
    """
    worthy = ch.change_worthy(remediations)
    fixes = worthy.select("fix_id", F.col("file").alias("path"), "line", "snippet", "suggested_fix")
    patched = stage(patch_files(files, fixes), "patched")
    changed, failed = changed_files(patched, root)
    when = F.current_timestamp() if timestamp is None else timestamp
    return ChangeSet(
        changed,
        failed,
        patched.where(F.col("kind") == "fix").select("path", "fix_id", "error"),
        ch.change_headline(worthy),
        ch.batch_label(worthy, when),
        ch.change_report(ch.number_changes(worthy, ["fix_id"])),
    )
