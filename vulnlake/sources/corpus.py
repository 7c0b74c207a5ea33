"""Corpus readers: weakness CSV, advisory YAML, Markdown guides, whole folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.domain import CHUNK_OVERLAP, CHUNK_SIZE
from vulnlake.functions.text import cve_aliases, guide_title, suffix_of
from vulnlake.operators.corpus import chunk_recursive, render_advisory, render_weakness, sections
from vulnlake.sources.csv_records import csv_rows
from vulnlake.sources.schemas import ADVISORY, CORPUS_SUFFIXES, DOCUMENT, WEAKNESS_COLUMNS


def plain_path(path: Column) -> Column:
    """File URI without its ``file:`` scheme; other schemes stay."""
    return F.regexp_replace(path, "^file:(//)?", "")


def file_name(uri: Column) -> Column:
    """Path of a file from its percent-encoded URI."""
    return plain_path(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def scan_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files below ``path`` as ``path, ext, content, length``; a missing folder is empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(_any_case(s) for s in suffixes) + "}")
    try:
        found = reader.load(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, ext string, content binary, length bigint")
    name = plain_path(F.col("path"))
    return found.select(name.alias("path"), suffix_of(name).alias("ext"), "content", "length")


def corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files by suffix (any case), in all sub-folders."""
    return scan_files(spark, path, CORPUS_SUFFIXES).where(F.col("ext").isin(*CORPUS_SUFFIXES))


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """Weakness CSV files with one common header -> documents."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    present = {old: new for old, new in WEAKNESS_COLUMNS.items() if old in raw.columns}
    named = raw.select(
        plain_path(F.col("_metadata.file_path")).alias("source"),
        *[F.col(f"`{old}`").alias(new) for old, new in present.items()],
        *[F.lit(None).cast("string").alias(new) for new in WEAKNESS_COLUMNS.values() if new not in present.values()],
    )
    return _weakness_documents(named)


def _weakness_documents(rows: DataFrame) -> DataFrame:
    return render_weakness(rows).select(
        "source",
        F.lit("cwe").alias("doc_type"),
        "content",
        F.col("cwe_label").alias("cwe_id"),
        F.coalesce("name", F.lit("")).alias("vulnerability_type"),
        F.coalesce("weakness_abstraction", F.lit("")).alias("weakness_abstraction"),
    )


def read_advisories(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: advisory YAML files -> (documents, ranges, failed).

    YAML becomes JSON once per file; everything after that is native. A range row joins
    the events of one range: ``introduced`` and the ``fixed`` or ``last_affected`` that
    ends it.
    """

    def to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, blob in zip(batch["path"], batch["content"]):
                try:
                    data = yaml.safe_load(bytes(blob).decode("utf-8"))
                    if not isinstance(data, dict):
                        raise ValueError("not a mapping")
                    rows.append((path, json.dumps(data, default=str), None))
                except Exception as exc:  # noqa: BLE001 - any parse failure is this file's error
                    rows.append((path, None, str(exc)))
            yield pd.DataFrame(rows, columns=["path", "raw", "error"])

    parsed = files.select("path", "content").mapInPandas(to_json, "path string, raw string, error string")
    failed = parsed.where(F.col("error").isNotNull()).select("path", "error")
    advisories = (
        parsed.where(F.col("error").isNull())
        .withColumn("_a", F.from_json("raw", ADVISORY))
        .select(F.col("path").alias("source"), "_a.*")
        .withColumn("id", F.coalesce("id", F.lit("Unknown")))
    )
    documents = render_advisory(advisories).select(
        "source",
        F.lit("pypa_advisory").alias("doc_type"),
        "content",
        F.col("id").alias("vulnerability_id"),
        F.coalesce(F.array_join("aliases", ", "), F.lit("")).alias("aliases"),
        F.coalesce(cve_aliases(F.col("aliases")), F.lit("")).alias("cve_ids"),
    )
    return documents, advisory_ranges(advisories), failed


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """Exploded ranges: ``vuln_id, ecosystem, package, introduced, fixed, last_affected``.

    In a list of events every ``introduced`` opens a range that the next ``fixed`` or
    ``last_affected`` closes. Commit ranges carry no versions and are left out.
    """
    spans = (
        advisories.select("id", F.explode("affected").alias("_p"))
        .select("id", "_p.package.ecosystem", "_p.package.name", F.explode("_p.ranges").alias("_r"))
        .where(F.coalesce("_r.type", F.lit("ECOSYSTEM")) != "GIT")
        .withColumn("_e", F.col("_r.events"))
        .select("id", "ecosystem", "name", "_e", F.posexplode("_e").alias("_i", "_event"))
        .where(F.map_contains_key("_event", "introduced"))
    )

    def closing(key: str) -> Column:
        following = F.get("_e", F.col("_i") + 1)
        return F.try_element_at(following, F.lit(key))

    return spans.select(
        F.col("id").alias("vuln_id"),
        "ecosystem",
        F.col("name").alias("package"),
        F.col("_event")["introduced"].alias("introduced"),
        closing("fixed").alias("fixed"),
        closing("last_affected").alias("last_affected"),
    )


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """Markdown guides -> ``source, title, text``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + _any_case(".md")).text(
        path, wholetext=True
    )
    source = plain_path(F.col("_metadata.file_path"))
    return raw.select(source.alias("source"), guide_title(source).alias("title"), F.col("value").alias("text"))


def guide_documents(guides: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Guides cut at headings; sections longer than ``size`` are split further.

    Every row is a finished chunk (``pre_chunked``), the parts of a long section too.
    """
    parts = sections(guides.withColumn("_key", F.struct("source", "title")), "_key", "text")
    small = parts.where(F.length("content") <= size)
    large = chunk_recursive(parts.where(F.length("content") > size).drop("seq"), size, overlap).drop("seq")
    return (
        small.drop("seq")
        .unionByName(large)
        .select(
            "_key.source",
            F.lit("owasp_cheatsheet").alias("doc_type"),
            "content",
            F.lit(True).alias("pre_chunked"),
            "_key.title",
            "h1", "h2", "h3",
        )
    )


def load_corpus(
    spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> tuple[DataFrame, DataFrame]:
    """All corpus files below ``path`` -> (documents, failed_files).

    A file that cannot be read becomes a ``(path, error)`` row and the others go on;
    failed reads are retried as Spark tasks. Documents have the columns of
    ``schemas.DOCUMENT``. CSV files are read by many tasks each, the others one per row.
    """
    files = scan_files(spark, path, tuple(s for s in CORPUS_SUFFIXES if s != ".csv"))
    weaknesses, bad_csv = csv_rows(spark, path, f"*{_any_case('.csv')}", WEAKNESS_COLUMNS, file_name(F.col("file")))
    advisories, _, bad_yaml = read_advisories(files.where(F.col("ext").isin(".yaml", ".yml")))
    markdown = files.where(F.col("ext") == ".md").withColumn("_text", F.col("content").cast("string"))
    readable = F.is_valid_utf8("_text")
    guides = markdown.where(readable).select(
        F.col("path").alias("source"), guide_title(F.col("path")).alias("title"), F.col("_text").alias("text")
    )
    bad_md = markdown.where(~readable).select("path", F.lit("not UTF-8 text").alias("error"))
    documents = spark.createDataFrame([], DOCUMENT)
    for part in (_weakness_documents(weaknesses), advisories, guide_documents(guides, size, overlap)):
        documents = documents.unionByName(part, allowMissingColumns=True)
    return documents, bad_csv.unionByName(bad_yaml).unionByName(bad_md)
