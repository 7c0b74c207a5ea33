"""Remediation: prompts, answers, parsing, review, roll-ups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import domain
from vulnlake.functions.text import WHITESPACE, strip, unescape_newlines

PROMPT_TEMPLATE = """Review a security finding and propose a repair.

Finding: {finding_type}
Location: {file_path}, line {line_number}
Severity: {severity}
Weakness: {cwe_id}

Code:
{original_code}

Guidance from the knowledge base:
{context}

Answer with one JSON object with the string fields suggested_fix, explanation,
confidence (High, Medium or Low) and cwe_id, and nothing else."""

# Fixed format: the fields of an answer.
FIX_SCHEMA = "suggested_fix string, explanation string, confidence string, cwe_id string"
FIX_FIELDS = ("suggested_fix", "explanation", "confidence", "cwe_id")


def retrieval_query(finding_type: Column, test_id: Column, description: Column, cwe: Column) -> Column:
    """Search text of a finding; absent parts leave no gap."""
    parts = [F.nullif(strip(c), F.lit("")) for c in (test_id, description, cwe)]
    return F.concat_ws(
        " ", F.coalesce(finding_type, F.lit("Unknown")), *parts, F.lit("vulnerability security fix")
    )


def render_prompt(df: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """P13 (with P10): add ``prompt``.

    Variables: finding_type, line_number, file_path, severity, cwe_id, original_code,
    context. The template is cut at its variables once, so a value that looks like a
    variable is never expanded.
    """

    def value(column: str, default: str) -> Column:
        if column not in df.columns:
            return F.lit(default)
        return F.coalesce(F.col(column).cast("string"), F.lit(default))

    values = {
        "finding_type": value("finding_type", "Unknown"),
        "line_number": value("line_number", "Unknown"),
        "file_path": value("file_path", "Unknown"),
        "severity": value("level", "Medium"),
        "cwe_id": value("cwe", ""),
        "original_code": unescape_newlines(value("code", "")),
        "context": value("context", ""),
    }
    pieces = re.split(r"\{(" + "|".join(values) + r")\}", template)
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return df.withColumn("prompt", F.concat(*parts))


def generate(
    prompts: DataFrame,
    load: Callable[[], Callable[[str], str]],
    key: str = "finding_id",
    tasks: int | None = None,
) -> DataFrame:
    """Run a user's model on each prompt -> ``(key, answer, error)``.

    ``load`` runs once per Python worker. Equal prompts are answered once and the answer
    is handed to all their rows. A failing prompt gives an ``error``, the job goes on.
    Prompts are dealt to ``tasks`` partitions (by default the session's shuffle
    partitions), which adaptive execution keeps, since a prompt is slow and its row small.
    """
    schema = T.StructType(
        [
            T.StructField("prompt", T.StringType()),
            T.StructField("answer", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                try:
                    rows.append((prompt, str(model(prompt)), None))
                except Exception as exc:  # noqa: BLE001 - any model failure is this row's error
                    rows.append((prompt, None, str(exc)))
            yield pd.DataFrame(rows, columns=["prompt", "answer", "error"])

    tasks = tasks or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prompts.select(key, F.sha2("prompt", 256).alias("_hash"), "prompt")
    once = keyed.groupBy("_hash").agg(F.first("prompt").alias("prompt")).repartition(tasks)
    answers = once.select("prompt").mapInPandas(run, schema).withColumn("_hash", F.sha2("prompt", 256)).drop("prompt")
    return keyed.drop("prompt").join(answers, "_hash", "left").drop("_hash")


def attach_responses(
    prompts: DataFrame, responses: DataFrame, hits: DataFrame | None = None, key: str = "finding_id"
) -> DataFrame:
    """Each prompt with its answer, a cached one first -> ``answer, from_cache``."""
    joined = prompts.join(responses.select(key, F.col("answer").alias("_fresh")), key, "left")
    if hits is None:
        joined = joined.withColumn("_cached", F.lit(None).cast("string"))
    else:
        joined = joined.join(hits.select(key, F.col("result").alias("_cached")), key, "left")
    return joined.select(
        *prompts.columns,
        F.coalesce("_cached", "_fresh").alias("answer"),
        F.col("_cached").isNotNull().alias("from_cache"),
    )


def _unfence(text: Column) -> Column:
    """Inside of a ```json or plain fence, up to the last fence; else the text."""
    tagged = F.regexp_extract(text, r"(?s)```json(.+)```", 1)
    plain = F.regexp_extract(text, r"(?s)^```(.+)```", 1)
    return strip(
        F.when(text.contains("```json"), F.when(tagged != "", tagged).otherwise(text))
        .when(text.startswith("```") & (plain != ""), plain)
        .otherwise(text)
    )


def _field_by_pattern(text: Column, field: str) -> Column:
    """A string field of a broken object, found by its name."""
    quoted = F.regexp_extract(text, rf"(?s)[\"']?{field}[\"']?\s*:\s*\"((?:[^\"\\]|\\.)*+)", 1)
    single = F.regexp_extract(text, rf"(?s)[\"']?{field}[\"']?\s*:\s*'((?:[^'\\]|\\.)*+)", 1)
    bare = F.regexp_replace(single, r"(?<!\\)\"", r'\\"')  # quotes need no escape between single ones
    found = F.when(quoted != "", quoted).when(single != "", bare)
    # read as a JSON string, so that every escape is undone exactly once
    options = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(F.concat(F.lit('{"v":"'), found, F.lit('"}')), "v string", options)["v"]


def parse_response(answer: Column) -> Column:
    """Model answer -> struct of FIX_FIELDS, null when hopeless.

    A fence is removed, then the JSON is read: an object as it is, of a list the first
    element. What does not parse is read again leniently (single quotes, bare field
    names, trailing commas), and last by field name. Any object with a key counts as an
    answer; fields it lacks are null.
    """
    body = _unfence(answer)
    is_list = F.ltrim(body).startswith("[")
    no_trailing_comma = F.regexp_replace(body, rf",{WHITESPACE}*([}}\]])", "$1")

    def read(text: Column, **options: str) -> Column:
        as_list = F.get(F.from_json(text, f"array<struct<{_ddl()}>>", options), F.lit(0))
        return F.when(is_list, as_list).otherwise(F.from_json(text, FIX_SCHEMA, options))

    def usable(fix: Column) -> Column:
        """from_json gives a struct of nulls for text that is no object."""
        return F.coalesce(*[fix[f] for f in FIX_FIELDS]).isNotNull()

    strict = read(body)
    first = F.when(is_list, F.get_json_object(body, "$[0]")).otherwise(body)
    is_object = F.coalesce(F.size(F.json_object_keys(first)) > 0, F.lit(False))
    lenient = read(
        no_trailing_comma, allowSingleQuotes="true", allowUnquotedFieldNames="true",
        allowBackslashEscapingAnyCharacter="true", allowUnquotedControlChars="true",
    )
    named = F.struct(*[_field_by_pattern(body, f).alias(f) for f in FIX_FIELDS])
    return (
        F.when(usable(strict) | is_object, strict)
        .when(usable(lenient), lenient)
        .when(body.contains("{") & usable(named), named)
    )


def _ddl() -> str:
    return ", ".join(f"{f}: string" for f in FIX_FIELDS)


def remediation_record(df: DataFrame, finding: Sequence[str], parsed: str = "parsed", sources: str = "sources") -> DataFrame:
    """``finding`` struct, answer fields with defaults, source list.

    ``sources`` is an array of structs with ``source`` and ``doc_type``. Rows whose
    answer could not be parsed yield no record.
    """
    unknown = F.lit("Unknown")
    fix = F.col(parsed)
    documents = F.transform(
        F.col(sources),
        lambda d: F.struct(
            F.coalesce(d["source"], unknown).alias("source"),
            F.coalesce(d["doc_type"], unknown).alias("doc_type"),
        ),
    )
    others = [c for c in df.columns if c not in {parsed, sources, *finding}]
    return df.where(fix.isNotNull()).select(
        *others,
        F.struct(*finding).alias("finding"),
        F.coalesce(fix["suggested_fix"], F.lit("")).alias("suggested_fix"),
        F.coalesce(fix["explanation"], F.lit("")).alias("explanation"),
        F.coalesce(fix["confidence"], unknown).alias("confidence"),
        F.coalesce(fix["cwe_id"], F.lit("")).alias("cwe_id"),
        documents.alias("source_documents"),
    )


def apply_review(remediations: DataFrame, decisions: DataFrame, order: str = "position") -> DataFrame:
    """J11 + W5: accepted records before the first ``q``.

    Everything before the first quit is everything with a smaller position than the
    smallest quit position: one aggregate instead of a running window over all rows.
    """
    quit_at = decisions.where(F.lower("choice") == "q").agg(F.min(order)).scalar()
    accepted = decisions.where(
        (F.lower("choice") == "y") & (quit_at.isNull() | (F.col(order) < quit_at))
    )
    return remediations.join(accepted.select(order), order, "left_semi")


def origin_counts(remediations: DataFrame, sast: DataFrame, finding: str = "finding") -> DataFrame:
    """Number of records whose finding is / is not in the code-finding list.

    Both sides shrink to their distinct findings first, so a finding that occurs very
    often is one row in the join. ``<=>`` treats null fields as equal.
    """
    mine = remediations.groupBy(F.col(finding).alias("_f")).agg(F.count("*").alias("_n"))
    known = sast.select(F.col(finding).alias("_g")).distinct().withColumn("_known", F.lit(True))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    in_list = F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0))
    return mine.join(known, F.col("_f").eqNullSafe(F.col("_g")), "left").agg(
        in_list.alias("sast_findings_count"), (total - in_list).alias("cve_findings_count")
    )


def origin_counts_by_column(remediations: DataFrame, origin: str = "origin") -> DataFrame:
    """J6 on the carried origin column, without a join; agrees with :func:`origin_counts`."""
    return remediations.agg(
        F.count_if(F.col(origin) == "sast").alias("sast_findings_count"),
        F.count_if(F.coalesce(F.col(origin) != "sast", F.lit(True))).alias("cve_findings_count"),
    )


def _count_labels(labels: DataFrame, domain_labels: Sequence[str], name: str) -> DataFrame:
    zeros = labels.sparkSession.createDataFrame([(v, 0) for v in domain_labels], f"{name} string, n bigint")
    return (
        labels.withColumn("n", F.lit(1).cast("bigint"))
        .unionByName(zeros)
        .groupBy(name)
        .agg(F.sum("n").alias("n"))
    )


def count_by_severity(remediations: DataFrame, severity: str = "severity", default: str = "medium") -> DataFrame:
    """A2: count per lower-cased severity; the four known ones always appear."""
    label = F.lower(F.coalesce(F.col(severity), F.lit(default)))
    return _count_labels(remediations.select(label.alias("severity")), list(domain.SEVERITY_RANK), "severity")


def count_by_confidence(remediations: DataFrame, confidence: str = "confidence", default: str = "Medium") -> DataFrame:
    """A3: count per confidence as written; High, Medium and Low always appear."""
    label = F.coalesce(F.col(confidence), F.lit(default))
    return _count_labels(remediations.select(label.alias("confidence")), domain.REMEDIATION_CONFIDENCES, "confidence")


def success_failure(attempted: DataFrame, parsed: str = "parsed") -> DataFrame:
    """A4: parsed and failed answers."""
    ok = F.col(parsed).isNotNull()
    return attempted.agg(
        F.count_if(ok).alias("successful_remediations"), F.count_if(~ok).alias("failed_remediations")
    )


def remediation_summary(
    attempted: DataFrame,
    approved: DataFrame,
    model_label: str,
    scan_timestamp: str | None = None,
    parsed: str = "parsed",
    severity: str = "severity",
    confidence: str = "confidence",
    origin: str = "origin",
) -> DataFrame:
    """A5: the roll-up row.

    Successes are counted over the attempts, before review; origins and breakdowns over
    the approved records. Both frames go through one aggregate. Labels outside the known
    ones are in ``other_severity`` and ``other_confidence``; A2 and A3 list them.
    """
    none = F.lit(None).cast("string")
    rows = attempted.select(
        F.lit(True).alias("try"), F.col(parsed).isNotNull().alias("ok"),
        none.alias("o"), none.alias("s"), none.alias("c"),
    ).unionByName(
        approved.select(
            F.lit(False).alias("try"), F.lit(False).alias("ok"),
            F.coalesce(F.col(origin), F.lit("cve")).alias("o"),
            F.lower(F.coalesce(F.col(severity), F.lit("medium"))).alias("s"),
            F.coalesce(F.col(confidence), F.lit("Medium")).alias("c"),
        )
    )
    tried, kept = F.col("try"), ~F.col("try")
    severities = list(domain.SEVERITY_RANK)
    counts = rows.agg(
        F.count_if(tried).alias("total_findings"),
        F.count_if(kept & (F.col("o") == "sast")).alias("sast_findings_count"),
        F.count_if(kept & (F.col("o") != "sast")).alias("cve_findings_count"),
        F.count_if(tried & F.col("ok")).alias("successful_remediations"),
        F.count_if(tried & ~F.col("ok")).alias("failed_remediations"),
        *[F.count_if(kept & (F.col("s") == v)).alias(f"severity_{v}") for v in severities],
        F.count_if(kept & ~F.col("s").isin(severities)).alias("other_severity"),
        *[F.count_if(kept & (F.col("c") == v)).alias(f"confidence_{v.lower()}") for v in domain.REMEDIATION_CONFIDENCES],
        F.count_if(kept & ~F.col("c").isin(domain.REMEDIATION_CONFIDENCES)).alias("other_confidence"),
    )
    return counts.select(
        F.lit(scan_timestamp).cast("string").alias("scan_timestamp"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("remediation_timestamp"),
        F.lit(model_label).alias("llm_info"),
        "*",
    )
