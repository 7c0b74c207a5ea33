"""Findings: normalise, classify, filter, summarise."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import domain
from vulnlake.functions.paths import segments
from vulnlake.functions.text import clean_snippet, lines_of, strip


def classify(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Add ``type`` by analyser rule id; an unknown id is an unknown vulnerability.

    The default rules frame is the fixed dimension and is broadcast; a caller's own
    frame is left to the optimizer.
    """
    if rules is None:
        rules = F.broadcast(domain.rules_frame(findings.sparkSession))
    return (
        findings.join(rules.withColumnRenamed("category", "_category"), "test_id", "left")
        .withColumn("type", F.coalesce("_category", F.lit(domain.UNKNOWN_CATEGORY)))
        .drop("_category")
    )


def normalise_levels(
    findings: DataFrame, severity: str = "issue_severity", confidence: str = "issue_confidence"
) -> tuple[DataFrame, DataFrame]:
    """P5: lower-case levels, missing -> low; rows with a level outside the domain go
    to the second frame with a ``reason``."""
    levelled = findings.withColumns(
        {
            "severity": F.lower(F.coalesce(F.col(severity), F.lit("low"))),
            "confidence": F.lower(F.coalesce(F.col(confidence), F.lit("low"))),
        }
    ).withColumn(
        "reason",
        F.when(
            ~F.col("severity").isin(*domain.SEVERITY_RANK),
            F.concat(F.lit("unknown severity: "), "severity"),
        ).when(
            ~F.col("confidence").isin(*domain.CONFIDENCE_RANK),
            F.concat(F.lit("unknown confidence: "), "confidence"),
        ),
    )
    good = levelled.where(F.col("reason").isNull()).drop("reason")
    return good, levelled.where(F.col("reason").isNotNull())


def map_results(
    results: DataFrame, rules: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """P4 + P5 + P6: raw analyser results to finding rows, plus quarantined rows."""
    good, bad = normalise_levels(classify(results, rules))
    findings = good.select(
        "type",
        F.col("line_number").cast("int").alias("line"),
        "severity",
        "confidence",
        clean_snippet(F.col("code")).alias("snippet"),
        F.col("issue_text").alias("description"),
        F.col("filename").alias("file"),
        F.col("test_id").alias("bandit_test_id"),
    )
    return findings, bad


def normalise_finding(findings: DataFrame) -> DataFrame:
    """One shape for code and dependency findings, defaults filled in.

    Reads ``package, version, cves`` (dependency rows, ``package`` not null) and
    ``type, file, line, snippet, severity, cwe_id``; columns that are absent count as
    null. Adds ``finding_type, file_path, line_number, code, level, cwe`` and leaves
    the input columns alone.
    """

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in findings.columns else F.lit(None).cast(kind)

    is_dep = col("package").isNotNull()
    cves = F.coalesce(col("cves", "array<string>"), F.array().cast("array<string>"))
    pinned = F.concat(
        col("package"),
        F.lit("=="),
        F.coalesce(col("version"), F.lit("")),
        F.lit("\nCVEs: "),
        F.array_join(cves, ", "),
    )
    unknown = F.lit("Unknown")
    return findings.withColumns(
        {
            "finding_type": F.when(
                is_dep, F.concat(F.lit("Vulnerable Dependency: "), col("package"))
            ).otherwise(F.coalesce(col("type"), unknown)),
            "file_path": F.coalesce(
                col("file"), F.when(is_dep, F.lit("requirements.txt")).otherwise(unknown)
            ),
            "line_number": F.when(is_dep, F.lit("N/A")).otherwise(
                F.coalesce(col("line").cast("string"), unknown)
            ),
            "code": F.when(is_dep, pinned).otherwise(F.coalesce(col("snippet"), F.lit(""))),
            "level": F.coalesce(col("severity"), F.lit("High")),
            "cwe": F.coalesce(col("cwe_id"), F.lit("")),
        }
    )


def min_level(findings: DataFrame, severity: str = "medium", confidence: str = "medium") -> DataFrame:
    """at or above both levels. A missing level counts as low."""
    sev = domain.severity_rank(F.coalesce("severity", F.lit("low")))
    conf = domain.rank_of(F.coalesce("confidence", F.lit("low")), domain.CONFIDENCE_RANK)
    return findings.where(
        (sev >= domain.SEVERITY_RANK[severity]) & (conf >= domain.CONFIDENCE_RANK[confidence])
    )


def _path_pattern(entry: str) -> str:
    """Regex for one exclusion: a directory (any depth) or a glob on the whole path."""
    if not re.search(r"[*?]", entry):
        return rf"(^|/){re.escape(entry.strip('/'))}(/|$)"
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", entry):
        out += {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return rf"^{out}$"


def exclude(
    findings: DataFrame,
    skip_ids: Sequence[str] = (),
    paths: Sequence[str] = (),
    file: str = "file",
    test_id: str = "test_id",
) -> DataFrame:
    """drop the given rule ids and every file below an excluded directory or glob."""
    keep = findings
    if skip_ids:
        keep = keep.where(~F.coalesce(F.col(test_id).isin(*skip_ids), F.lit(False)))
    if paths:
        pattern = "|".join(_path_pattern(p) for p in paths)
        keep = keep.where(~F.coalesce(F.col(file).rlike(pattern), F.lit(False)))
    return keep


def union_findings(code: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Code findings and dependency findings in one frame with their ``origin``."""
    return code.withColumn("origin", F.lit("sast")).unionByName(
        dependencies.withColumn("origin", F.lit("cve")), allowMissingColumns=True
    )


def select_origin(findings: DataFrame, sast_only: bool = False, cve_only: bool = False) -> DataFrame:
    """one origin or both; ``sast_only`` wins when both flags are set."""
    if sast_only:
        return findings.where(F.col("origin") == "sast")
    if cve_only:
        return findings.where(F.col("origin") == "cve")
    return findings


def severity_at_least(findings: DataFrame, level: str, severity: str = "severity") -> DataFrame:
    """rank at or above ``level``; a missing or unknown severity counts as low.

    Dependency findings carry no severity, so any level above low drops them.
    """
    return findings.where(
        domain.severity_rank(F.col(severity), default=1) >= domain.SEVERITY_RANK[level]
    )


def scan_summary(findings: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """A1: one row with both totals and the count of each severity, zeros included.

    Both inputs go through a single aggregate, no join.
    """
    rows = findings.select(F.col("severity").alias("s"), F.lit(False).alias("dep"))
    if dependencies is not None:
        rows = rows.union(
            dependencies.select(F.lit(None).cast("string").alias("s"), F.lit(True).alias("dep"))
        )
    code = ~F.col("dep")
    return rows.agg(
        F.count_if(code).alias("total_findings"),
        F.count_if(F.col("dep")).alias("total_cve_findings"),
        *[
            F.count_if(code & (F.col("s") == level)).alias(level)
            for level in ("low", "medium", "high", "critical")
        ],
    )


def common_root(files: DataFrame, file: str = "file", by: Sequence[str] = ()) -> DataFrame:
    """Deepest directory shared by all files (per key).

    The common prefix of a set of segment arrays is the common prefix of its smallest
    and largest member, so two mergeable aggregates are enough.
    """
    parts = segments(F.col(file))
    folder = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bounds = files.groupBy(*by).agg(F.min(folder).alias("_lo"), F.max(folder).alias("_hi"))
    same = F.zip_with("_lo", "_hi", lambda a, b: a.eqNullSafe(b))
    cut = F.array_position(same, False).cast("int")
    prefix = F.when(cut == 0, F.col("_lo")).otherwise(
        F.slice("_lo", F.lit(1), F.greatest(cut - 1, F.lit(0)))
    )
    return bounds.select(*by, F.array_join(prefix, "/").alias("common_root"))


@dataclass(frozen=True)
class PatternRule:
    """One detection rule of :func:`rule_scan`."""

    test_id: str
    pattern: str
    severity: str
    confidence: str

    @property
    def category(self) -> str:
        return domain.RULE_CATEGORIES.get(self.test_id, domain.UNKNOWN_CATEGORY)


def rule_scan(
    documents: DataFrame, rules: Sequence[PatternRule], key: str = "path", text: str = "content"
) -> DataFrame:
    """Pattern rules over every line of every text -> findings.

    The rules are configuration, so each becomes a constant expression with its regex
    compiled once; there is no join with a rules table. One combined pattern discards
    most lines first.
    """
    line = F.col("_line")
    lines = documents.select(key, F.posexplode(lines_of(F.col(text))).alias("_no", "_line"))
    hits = F.array(
        *[
            F.when(
                line.rlike(r.pattern),
                F.struct(
                    F.lit(r.test_id).alias("test_id"),
                    F.lit(r.category).alias("type"),
                    F.lit(r.severity).alias("severity"),
                    F.lit(r.confidence).alias("confidence"),
                ),
            )
            for r in rules
        ]
    )
    return (
        lines.where(line.rlike("|".join(f"(?:{r.pattern})" for r in rules)))
        .withColumn("_hit", F.explode(F.array_compact(hits)))
        .select(key, (F.col("_no") + 1).alias("line"), "_hit.*", strip(line).alias("snippet"))
    )
