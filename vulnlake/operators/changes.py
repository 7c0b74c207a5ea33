"""Change sets: which fixes qualify, headline, label, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import severity_rank
from vulnlake.operators.ranking import number_rows, top_k

# Fixed format of the headline; the other report texts are our own.
EMPTY_HEADLINE = "Fix security vulnerabilities"


def change_worthy(
    remediations: DataFrame, severity: str = "severity", confidence: str = "confidence"
) -> DataFrame:
    """severity high or critical and confidence high, in any case."""
    return remediations.where(
        F.lower(severity).isin("high", "critical") & (F.lower(confidence) == "high")
    )


def any_rows(df: DataFrame, name: str = "worthy") -> DataFrame:
    """F5 flag: one row, true when there is at least one."""
    return df.limit(1).agg((F.count("*") > 0).alias(name))


def change_headline(
    remediations: DataFrame, by: Sequence[str] = (), severity: str = "severity", kind: str = "type"
) -> DataFrame:
    """Total, highest severity, first three types and the headline, per key.

    Counts per (key, type) come first; of these only three per key are listed.
    """
    level = F.lower(F.coalesce(F.col(severity), F.lit("medium")))
    per_type = (
        remediations.withColumn("_type", F.coalesce(F.col(kind), F.lit("Unknown")))
        .groupBy(*by, "_type")
        .agg(
            F.count("*").alias("_n"),
            F.max(F.struct(severity_rank(level, 0).alias("rank"), level.alias("level"))).alias("_top"),
        )
    )
    totals = per_type.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.max("_top")["level"].alias("highest"),
        F.count("*").alias("_types"),
    )
    listed = F.array_join(F.array_sort(F.collect_list("_type")), ", ")
    if by:
        names = top_k(per_type, by, [F.col("_type")], 3, "_nth").groupBy(*by).agg(listed.alias("_names"))
        joined = totals.join(names, list(by))
    else:
        first = per_type.orderBy("_type").limit(3).agg(listed)
        joined = totals.withColumn("_names", first.scalar())
    types = F.concat("_names", F.when(F.col("_types") > 3, ", ...").otherwise(""))
    headline = F.when(F.col("total") == 0, EMPTY_HEADLINE).otherwise(
        F.concat(F.lit("Fix "), "total", F.lit(" "), "highest", F.lit(" vulnerabilities ("), types, F.lit(")"))
    )
    title = F.when(F.col("total") == 0, EMPTY_HEADLINE).otherwise(
        F.concat(F.lit("Fix "), "total", F.lit(" "), "highest", F.lit(" security vulnerabilities"))
    )
    return joined.select(*by, "total", "highest", types.alias("types"), headline.alias("headline"), title.alias("title"))


def batch_label(
    remediations: DataFrame,
    timestamp: Column,
    by: Sequence[str] = (),
    severity: str = "severity",
    prefix: str = "vulnlake",
) -> DataFrame:
    """Label of a change set: its severity class and a timestamp."""
    level = F.lower(F.coalesce(F.col(severity), F.lit("")))
    flags = remediations.groupBy(*by).agg(
        F.coalesce(F.bool_or(level == "critical"), F.lit(False)).alias("_critical"),
        F.coalesce(F.bool_or(level == "high"), F.lit(False)).alias("_high"),
    )
    group = (
        F.when(F.col("_critical"), "critical-fixes")
        .when(F.col("_high"), "high-severity")
        .otherwise("automated-fixes")
    )
    stamp = F.date_format(timestamp, "yyyyMMdd-HHmmss")
    return flags.select(*by, F.concat_ws("-", F.lit(prefix), group, stamp).alias("label"))


def number_changes(remediations: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fixes numbered from 1 (per key) without gathering them in one task."""
    return number_rows(remediations, by, [F.col(c) for c in order], "number", "changes")


def table_line() -> Column:
    """A10: one line of the summary table."""
    def cell(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    return F.concat(
        F.lit("| "), cell("type", "Unknown"), F.lit(" | `"), cell("file", "Unknown"),
        F.lit("` | "), cell("line", "N/A"), F.lit(" | **"), cell("severity", "Unknown"),
        F.lit("** | "), cell("confidence", "Unknown"), F.lit(" | "), cell("cwe_id", "N/A"), F.lit(" |"),
    )


def detail_text() -> Column:
    """A10: the detail section of one numbered fix."""
    def field(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    return F.concat(
        F.lit("### "), field("file", "Unknown"), F.lit(" line "), field("line", "N/A"),
        F.lit("\n\nFix "), F.col("number"), F.lit(" for "), field("type", "Unknown"),
        F.lit("\nSeverity: "), field("severity", "Unknown"),
        F.lit(", confidence: "), field("confidence", "Unknown"), F.lit("\n\n"),
        field("explanation", "No explanation given."),
        F.lit("\n\nBefore:\n```python\n"), field("snippet", "# no snippet"),
        F.lit("\n```\n\nAfter:\n```python\n"), field("suggested_fix", "# no fix"), F.lit("\n```\n"),
    )


def change_report(numbered: DataFrame, by: Sequence[str] = (), checklist: Sequence[str] = ()) -> DataFrame:
    """A10: the Markdown report as rows ``(by, section, number, part, text)``.

    Sections: 1 opening, 2 table, 3 details, 4 checklist, 5 sources. Sorted by
    (section, number, part) the texts are the report. It stays a table, because a report
    on very many fixes fits neither one value nor one task; a range-sorted write keeps
    the order. ``checklist`` holds the lines of section 4. Reads the columns of ``number_changes`` and ``source_documents``.
    """
    def rows(df: DataFrame, section: int, number: Column, part: Column, text: Column) -> DataFrame:
        return df.select(
            *by, F.lit(section).alias("section"), number.cast("bigint").alias("number"),
            part.cast("int").alias("part"), text.alias("text"),
        )

    zero = F.lit(0)
    totals = numbered.groupBy(*by).agg(F.count("*").alias("_n"))
    opening = F.array(
        F.lit("## Security fixes\n"),
        F.concat(F.lit("This change repairs "), F.col("_n"), F.lit(" findings.\n")),
        F.lit("| Type | File | Line | Severity | Confidence | CWE |"),
        F.lit("|------|------|------|----------|------------|-----|"),
    )
    heads = totals.select(*by, F.posexplode(opening).alias("_part", "_text"))
    checks = totals.select(*by, F.posexplode(F.array(*map(F.lit, checklist)).cast("array<string>")).alias("_part", "_text"))
    sources = numbered.where(F.size("source_documents") > 0).select(
        *by, "number", F.posexplode("source_documents").alias("_part", "_doc")
    )
    source_text = F.concat(
        F.lit("- fix "), "number", F.lit(": "), F.coalesce("_doc.source", F.lit("Unknown")),
        F.lit(" ("), F.coalesce("_doc.doc_type", F.lit("Unknown")), F.lit(")"),
    )
    return (
        rows(heads, 1, zero, F.col("_part"), F.col("_text"))
        .unionByName(rows(numbered, 2, F.col("number"), zero, table_line()))
        .unionByName(rows(numbered, 3, F.col("number"), zero, detail_text()))
        .unionByName(rows(checks, 4, zero, F.col("_part"), F.col("_text")))
        .unionByName(rows(sources, 5, F.col("number"), F.col("_part"), source_text))
    )
