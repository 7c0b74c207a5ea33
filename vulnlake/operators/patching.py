"""Apply fixes to source files (J10) and relate paths to a root."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import FUZZY_THRESHOLD, SEARCH_RADIUS
from vulnlake.functions.paths import relative_to
from vulnlake.functions.similarity import ratio_at_least
from vulnlake.operators.locating import patchable

PATCH_SCHEMA = (
    "kind string, path string, fix_id string, content string, n_applied bigint, n_failed bigint, error string"
)


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip())


def _is_import(line: str) -> bool:
    return line.lstrip().startswith(("import ", "from "))


def _plain(code: str) -> str:
    return code.replace("  # ", " # ").replace("\n", " ").strip()


class _File:
    """One file while its fixes come in, last line first."""

    def __init__(self, content: str) -> None:
        self.lines = content.splitlines(keepends=True)
        self.imports: set[str] = set()
        self.applied = self.failed = 0

    def place(self, line: int, snippet: str) -> int | None:
        """Index where the snippet stands near 1-based ``line``."""
        height = snippet.count("\n") + 1
        target = line - 1
        stop = min(target + SEARCH_RADIUS, len(self.lines) - height) + 1
        spots = range(max(0, target - SEARCH_RADIUS), max(0, stop))
        texts = ["".join(self.lines[i:i + height]) for i in spots]
        wanted = _plain(snippet)
        for i, text in zip(spots, texts):
            if wanted and _plain(text) == wanted:
                return i
        best, where = 0.0, None
        bare = snippet.strip()
        for i, text in zip(spots, texts):
            ratio = ratio_at_least(bare, text.strip(), FUZZY_THRESHOLD)
            if ratio is not None and ratio > best:
                best, where = ratio, i
        return where

    def reach(self, start: int, height: int) -> int:
        """End of the replaced lines: a matched def or class goes with its whole block."""
        span = range(start, min(start + height, len(self.lines)))
        head = next((i for i in span if self.lines[i].lstrip().startswith(("def ", "class "))), None)
        if head is None:
            return start + height
        end = head + 1
        for i in range(head + 1, len(self.lines)):
            if not self.lines[i].strip():
                continue
            if _depth(self.lines[i]) <= _depth(self.lines[head]):
                break
            end = i + 1
        return end

    def apply(self, line: int, snippet: str, fix: str) -> str | None:
        """Replace the snippet; the error text when it cannot be found."""
        rows = fix.split("\n")
        self.imports.update(r.strip() for r in rows if _is_import(r))
        code = [r for r in rows if not _is_import(r)]
        solid = [i for i, r in enumerate(code) if r.strip()]
        code = code[solid[0]:solid[-1] + 1] if solid else [""]
        start = self.place(line, snippet)
        if start is None:
            self.failed += 1
            return f"no match of similarity {FUZZY_THRESHOLD} or more near line {line}"
        end = self.reach(start, snippet.count("\n") + 1)
        base = next((_depth(r) for r in self.lines[start:end] if r.strip()), 0)
        least = min((_depth(r) for r in code if r.strip()), default=0)
        self.lines[start:end] = [
            " " * (base + _depth(r) - least) + r.lstrip() + "\n" if r.strip() else "\n" for r in code
        ]
        self.applied += 1
        return None

    def content(self) -> str:
        text = "".join(self.lines)
        rows = text.split("\n")
        present = {r.strip() for r in rows if _is_import(r)}
        new = sorted(self.imports - present)
        if not new:
            return text
        anchor = 0
        block = False
        for i, row in enumerate(rows):
            bare = row.strip()
            if _is_import(row):
                block, anchor = True, i + 1
            elif block and bare and not bare.startswith("#"):
                break
        if not block:
            opening = ("#", '"""', "'''")
            anchor = next((i for i, r in enumerate(rows) if r.strip() and not r.strip().startswith(opening)), 0)
        return "\n".join(rows[:anchor] + new + rows[anchor:])


def _patch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive per path: the file first, then its fixes. Only one file is held."""
    columns = [c.split()[0] for c in PATCH_SCHEMA.split(", ")]
    path, current, missing = None, None, False

    def close() -> list[tuple]:
        if current is None:
            return []
        return [("file", path, None, current.content(), current.applied, current.failed, None)]

    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            if row.path != path:
                out += close()
                path, current, missing = row.path, None, False
            if row.is_file:
                current = _File(row.content)
            elif current is None:
                if not missing:
                    out.append(("missing", path, None, None, None, None, "File not found"))
                missing = True
            else:
                error = current.apply(int(row.line), row.snippet, row.suggested_fix)
                if error:
                    out.append(("fix", path, row.fix_id, None, None, None, error))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(close(), columns=columns)


def patch_files(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Apply all fixes of each file, from its last line up.

    Reads ``path, content`` and ``fix_id, path, line, snippet, suggested_fix``. Result
    rows by ``kind``: ``file`` (new content and counts; also when no fix could be placed),
    ``fix`` (one that could not be placed) and ``missing`` (no such file).

    A fix sees the text its predecessors left, so a file is worked on in order. Its rows
    are sorted and streamed: a task holds one file and one Arrow batch of fixes, however
    many fixes a file has. Files without fixes are dropped before the shuffle.
    """
    usable = patchable(fixes)
    touched = files.join(usable.select("path").distinct(), "path", "left_semi")
    rows = touched.select(
        "path", F.lit(True).alias("is_file"), "content",
        F.lit(0).alias("line"), F.lit(None).cast("string").alias("fix_id"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("suggested_fix"),
    ).unionByName(
        usable.select(
            "path", F.lit(False).alias("is_file"), F.lit(None).cast("string").alias("content"),
            F.coalesce(F.col("line"), F.lit(1)).cast("int").alias("line"),
            F.col("fix_id").cast("string").alias("fix_id"), "snippet", "suggested_fix",
        )
    )
    ordered = rows.repartition("path").sortWithinPartitions(
        "path", F.desc("is_file"), F.desc("line"), F.length("fix_id"), "fix_id"
    )
    return ordered.mapInPandas(_patch, PATCH_SCHEMA)


def relative_paths(df: DataFrame, root: str | None = None, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows with ``relative_path`` below the root, and the rows outside with ``error``.

    ``root`` is a path, or null to read a ``root`` column.
    """
    base = F.col("root") if root is None else F.lit(root)
    rel = df.withColumn("relative_path", relative_to(F.col(path), base))
    outside = rel.where(F.col("relative_path").isNull()).drop("relative_path")
    return (
        rel.where(F.col("relative_path").isNotNull()),
        outside.withColumn("error", F.concat(F.col(path), F.lit(" is not below "), base)),
    )
