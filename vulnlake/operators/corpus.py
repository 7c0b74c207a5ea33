"""Corpus: render records as documents, cut documents into sections and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import CHUNK_OVERLAP, CHUNK_SIZE
from vulnlake.functions.folds import bound, runs
from vulnlake.functions.text import is_blank, lines_of, strip

# --- Fixed values: separators of the recursive splitter, coarsest first ------
SEPARATORS = ("\n\n", "\n", " ", "")
# -----------------------------------------------------------------------------


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def render_weakness(df: DataFrame) -> DataFrame:
    """Weakness rows -> ``content``, ``cwe_label``.

    Reads ``cwe_id, name, description, extended_description, mitigations``; the two
    last sections appear only when they hold text.
    """
    number = F.coalesce(F.col("cwe_id"), F.lit("Unknown"))
    extended, fixes = _or_empty(F.col("extended_description")), _or_empty(F.col("mitigations"))
    content = F.concat(
        F.lit("CWE-"), number, F.lit(": "), _or_empty(F.col("name")),
        F.lit("\n\nDescription: "), _or_empty(F.col("description")), F.lit("\n\n"),
        F.when(extended != "", F.concat(F.lit("Extended Description: "), extended, F.lit("\n\n"))).otherwise(""),
        F.when(fixes != "", F.concat(F.lit("Mitigations:\n"), fixes)).otherwise(""),
    )
    return df.withColumns({"content": content, "cwe_label": F.concat(F.lit("CWE-"), number)})


def render_advisory(df: DataFrame) -> DataFrame:
    """Advisories (``id, details, affected, references``) -> ``content``.

    ``affected`` is ``array<struct<package struct<name, ecosystem>, ranges
    array<struct<events array<map<string,string>>>>>>``.
    """
    unknown = F.lit("Unknown")

    def event_line(event: Column) -> Column:
        first = F.map_entries(event)[0]
        return F.concat(F.lit("    - "), first["key"], F.lit(": "), _or_empty(first["value"]), F.lit("\n"))

    def range_lines(rng: Column) -> Column:
        return _or_empty(F.array_join(F.transform(rng["events"], event_line), ""))

    def package_lines(item: Column) -> Column:
        return F.concat(
            F.lit("  - "), F.coalesce(item["package"]["name"], unknown),
            F.lit(" ("), F.coalesce(item["package"]["ecosystem"], unknown), F.lit(")\n"),
            _or_empty(F.array_join(F.transform(item["ranges"], range_lines), "")),
        )

    def reference_line(ref: Column) -> Column:
        return F.concat(
            F.lit("  - ["), F.coalesce(ref["type"], F.lit("LINK")), F.lit("] "),
            _or_empty(ref["url"]), F.lit("\n"),
        )

    content = F.concat(
        F.lit("Vulnerability ID: "), F.coalesce(F.col("id"), unknown),
        F.lit("\n\nDetails: "), _or_empty(F.col("details")), F.lit("\n\n"),
        F.when(
            F.size("affected") > 0,
            F.concat(F.lit("Affected Packages:\n"), F.array_join(F.transform("affected", package_lines), "")),
        ).otherwise(""),
        F.when(
            F.size("references") > 0,
            F.concat(F.lit("\nReferences:\n"), F.array_join(F.transform("references", reference_line), "")),
        ).otherwise(""),
    )
    return df.withColumn("content", content)


def _headed(lines: Column) -> Column:
    """Lines with their heading level (0: none) and title; what stands in a code fence is no heading.

    The lines are cut into runs at the fences, and every other run is inside.
    """

    def marked(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,3}) ", 1))
        title = F.when(level > 0, strip(F.regexp_replace(line, r"^#{1,3} ", "")))
        return F.struct(line.alias("line"), level.alias("level"), title.alias("title"), line.rlike(r"^\s*(```|~~~)").alias("fence"))

    def placed(rows: Column) -> Column:
        fences = F.when(rows[0]["fence"], 1).otherwise(0)  # before the second line

        def outside(run: Column, k: Column) -> Column:
            level = lambda r: F.when((k + fences) % 2 == 0, r["level"]).otherwise(0)
            return F.transform(run, lambda r: F.struct(r["line"].alias("line"), level(r).alias("level"), r["title"].alias("title")))

        return F.flatten(F.transform(runs(rows, lambda r: r["fence"]), outside))

    return bound(F.transform(lines, marked), placed)


def _sections(text: Column) -> Column:
    """Sections of a text: ``start`` (line number), ``h1, h2, h3`` in force, and their ``lines``.

    A section begins at each heading. Sections are gathered under their first-level heading, and
    these runs again under the second level, so that every heading finds those above it at the head of
    its runs: the work follows the lines and headings, not their product.
    """

    def title(row: Column, level: int) -> Column:
        return F.when(row["level"] == level, row["title"])

    def numbered(rows: Column) -> Column:
        return F.transform(rows, lambda r, i: F.struct((i + 1).alias("no"), r["line"].alias("line"), r["level"].alias("level"), r["title"].alias("title")))

    def under_first(run: Column) -> Column:
        def under_second(inner: Column) -> Column:
            def section(lines: Column) -> Column:
                first = lines[0]
                return F.struct(
                    first["no"].alias("start"), title(run[0][0], 1).alias("h1"), title(inner[0][0], 2).alias("h2"), title(first, 3).alias("h3"),
                    F.transform(lines, lambda r: r["line"]).alias("lines"),
                )

            return F.transform(inner, section)

        return F.flatten(F.transform(runs(run, lambda s: s[0]["level"].isin(1, 2)), under_second))

    parts = bound(bound(_headed(lines_of(text)), numbered), lambda rows: runs(rows, lambda r: r["level"] > 0))
    return F.flatten(F.transform(bound(parts, lambda p: runs(p, lambda s: s[0]["level"] == 1)), under_first))


def header_path(documents: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """Every line with the headings it stands under.

    Works inside the row that holds the document, so nothing is shuffled, and a line's row
    carries its own headings only.
    """
    found = documents.select(key, F.explode(_sections(F.col(text))).alias("_s"))
    # a section's lines are a column of their own, which its exploded rows then do not carry
    found = found.select(key, "_s.start", "_s.h1", "_s.h2", "_s.h3", F.col("_s.lines").alias("_lines"))
    lines = found.select(key, "start", "h1", "h2", "h3", F.posexplode("_lines").alias("_pos", "line"))
    return lines.select(key, (F.col("start") + F.col("_pos")).alias("line_no"), "line", "h1", "h2", "h3")


def sections(documents: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """One row per heading section, its heading line kept -> ``seq, h1..h3, content``."""
    found = documents.select(key, F.explode(_sections(F.col(text))).alias("_s"))
    cut = found.select(key, F.col("_s.start").alias("seq"), "_s.h1", "_s.h2", "_s.h3", F.array_join("_s.lines", "\n").alias("content"))
    return cut.where(~is_blank(F.col("content")))


def needs_splitting(documents: DataFrame, flag: str = "pre_chunked") -> tuple[DataFrame, DataFrame]:
    """documents that are chunks already, and documents still to split."""
    ready = F.coalesce(F.col(flag), F.lit(False))
    return documents.where(ready), documents.where(~ready)


def _pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs."""
    sep, finer = next(
        (s, separators[i + 1:]) for i, s in enumerate(separators) if s == "" or s in text
    )
    if sep == "":
        parts = list(text)
    else:
        head, *rest = text.split(sep)
        parts = [p for p in [head, *(sep + r for r in rest)] if p]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        piece = "".join(window).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) >= size and finer:
            emit()
            window, held = [], 0
            out.extend(_pieces(part, size, overlap, finer))
            continue
        if held + len(part) > size:
            emit()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    emit()
    return out


def chunk_recursive(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "content"
) -> DataFrame:
    """Split texts at paragraph, line, word or character, in this order of preference.

    Every piece has at most ``size`` characters and shares up to ``overlap`` with the one
    before it. Adds ``seq`` from 1 and replaces the text column; the other columns are
    copied to each piece. Only the text passes through Python.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _pieces(t, size, overlap, SEPARATORS) if t else [])

    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(split(F.col(text))).alias("_pos", text)).select(
        *others, (F.col("_pos") + 1).alias("seq"), text
    )


def chunk_window(
    documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, text: str = "content"
) -> DataFrame:
    """Fixed windows of ``size`` characters every ``size - overlap``; all native."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    others = [c for c in documents.columns if c != text]
    body = F.col(text)
    # No window may consist of the overlap alone.
    last = F.greatest(F.lit(1), F.length(body) - overlap)
    starts = F.sequence(F.lit(1), last, F.lit(size - overlap))
    return (
        documents.where(F.length(body) > 0)
        .select(*others, text, F.posexplode(starts).alias("_pos", "_start"))
        .select(
            *others,
            (F.col("_pos") + 1).alias("seq"),
            F.substring(body, F.col("_start"), F.lit(size)).alias(text),
        )
    )


def union_chunks(pre_chunked: DataFrame, split: DataFrame, index_prechunked: bool = True) -> DataFrame:
    """Ready chunks and fresh ones; ``index_prechunked=False`` keeps the fresh only."""
    if not index_prechunked:
        return split
    return pre_chunked.unionByName(split, allowMissingColumns=True)


def index_stats(chunks: DataFrame, doc_type: str = "doc_type", source: str = "source") -> DataFrame:
    """Chunk count and mean length per source, per type and in total.

    ``level`` is 0 for a source, 1 for a type, 3 for the grand total.
    """
    return chunks.rollup(doc_type, source).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("chunks"),
        F.avg(F.length("content")).alias("mean_length"),
    )


def failed_summary(failed: DataFrame) -> DataFrame:
    """Every failed file by its name, with the number of failures.

    The count is joined as a one-value subquery; the list stays a table, since it can
    be as long as the corpus.
    """
    total = failed.agg(F.count("*")).scalar()
    return failed.select(
        F.substring_index("path", "/", -1).alias("file_name"), "error", total.alias("failed_total")
    )
