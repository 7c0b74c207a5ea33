"""Dependency manifests."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions.text import decode_text
from vulnlake.operators.dependencies import parse_requirements, parse_specs
from vulnlake.sources.corpus import scan_files


def read_requirements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S7 + S9: text manifests (``path, content`` bytes) -> (dependencies, failed)."""
    texts = files.select(F.col("path").alias("file"), decode_text("content").alias("content"))
    good, bad = parse_requirements(texts)
    return good, bad.select(F.col("file").alias("path"), "error")


def read_projects(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project TOML files -> (dependencies, failed).

    One row per requirement with a usable version; files without the section give none.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, blob in zip(batch["path"], batch["content"]):
                try:
                    project = tomllib.loads(bytes(blob).decode("utf-8")).get("project", {})
                    specs = [str(s) for s in project.get("dependencies", [])]
                    rows.append((path, specs, None))
                except (UnicodeDecodeError, tomllib.TOMLDecodeError, AttributeError, TypeError) as exc:
                    rows.append((path, [], str(exc)))
            yield pd.DataFrame(rows, columns=["file", "specs", "error"])

    parsed = files.select("path", "content").mapInPandas(parse, "file string, specs array<string>, error string")
    failed = parsed.where(F.col("error").isNotNull()).select(F.col("file").alias("path"), "error")
    specs = parsed.select("file", F.explode("specs").alias("spec"))
    pinned = parse_specs(specs).where(F.col("package").isNotNull() & F.col("version").isNotNull())
    return pinned.select("file", "package", "version"), failed


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every manifest below ``path``: exactly ``.toml`` by S8, all else by S7."""
    files = scan_files(spark, path)
    is_toml = F.col("path").endswith(".toml")
    text, bad_text = read_requirements(files.where(~is_toml))
    toml, bad_toml = read_projects(files.where(is_toml))
    return text.unionByName(toml), bad_text.unionByName(bad_toml)
