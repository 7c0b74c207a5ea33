"""Quoted CSV files of any size, read by many tasks.

A quoted field may hold line breaks, so where a record begins depends on all quotes before it. The
files are read by lines, whose ranges Spark splits as it likes. Every line is a function of two states
(outside or inside quotes), told by two patterns; a range's function is that of its lines one after
the other, and the ranges of a file (a few rows) give the state in which each begins. With these
every task cuts its own range into records, and only the pieces of records that reach over a
range's end are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake.session import stage

FETCH = 500_000  # rows of file ranges or headers that may be broadcast
_QUOTED = r'(?:[^"]++|"")*+'  # inside quotes, up to the quote that ends them
_REST = r"[^,\r]*+"  # what follows a closing quote up to the next field
_FIELDS = rf'(?:"{_QUOTED}"{_REST}|[^",\r][^,\r]*+)?+'
#: a line that begins outside of quotes, or inside, and ends inside
_TO_OPEN = rf'(?:{_FIELDS}[,\r])*+"{_QUOTED}'
_OUT_IN = rf"(?s)^{_TO_OPEN}\z"
_IN_IN = rf'(?s)^(?:{_QUOTED}|{_QUOTED}"{_REST}[,\r]{_TO_OPEN})\z'


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``file, range, line, text, out_in, in_in, valid`` in file order within each task."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("text")
    )
    valid = F.is_valid_utf8("text")
    # a file with other bytes fails as a whole, so what its lines hold does not matter
    read = raw.select("file", "range", F.when(valid, F.col("text")).otherwise("").alias("text"), valid.alias("valid"))
    return read.select("*", F.col("text").rlike(_OUT_IN).alias("out_in"), F.col("text").rlike(_IN_IN).alias("in_in"))


def _after(state: np.ndarray | bool, out_in: np.ndarray, in_in: np.ndarray) -> np.ndarray:
    """Whether each line ends inside quotes, given whether the first begins there."""
    n = len(out_in)
    fixed = np.where(out_in == in_in, np.arange(n), -1)
    last = np.maximum.accumulate(fixed)
    turns = np.cumsum(out_in & ~in_in)
    begin = np.where(last >= 0, out_in[np.maximum(last, 0)], state)
    return begin ^ ((turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)) % 2 == 1)


def _runs(batch: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Parts of a batch that lie in one range."""
    keys = list(zip(batch["file"], batch["range"]))
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield keys[a], batch.iloc[a:b]


def _range_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per range: the state at its end for either state at its beginning, and whether all is UTF-8."""
    columns = ["file", "range", "from_out", "from_in", "valid"]
    current, ends, valid = None, (False, True), True
    for batch in batches:
        for key, part in _runs(batch):
            if key != current:
                if current is not None:
                    yield pd.DataFrame([(*current, *ends, valid)], columns=columns)
                current, ends, valid = key, (False, True), True
            out_in, in_in = part["out_in"].to_numpy(bool), part["in_in"].to_numpy(bool)
            ends = tuple(bool(_after(e, out_in, in_in)[-1]) for e in ends)
            valid = valid and bool(part["valid"].all())
    if current is not None:
        yield pd.DataFrame([(*current, *ends, valid)], columns=columns)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each range: ``kind`` 0 whole, 1 begun here and open at the end, 2 begun before."""
    columns = ["file", "range", "kind", "first", "text"]
    current, state, held, kind, first = None, False, [], 0, False

    def given(open_: bool) -> list[tuple]:
        return [(*current, 1 if kind == 0 and open_ else kind, first, "\n".join(held))] if held else []

    for batch in batches:
        rows = []
        for key, part in _runs(batch):
            if key != current:
                rows += given(state) if current is not None else []
                current, state, held, kind, first = key, bool(part["begins_inside"].iloc[0]), [], 2, False
                fresh = key[1] == 0
            else:
                fresh = False
            after = _after(state, part["out_in"].to_numpy(bool), part["in_in"].to_numpy(bool))
            before = np.concatenate([[state], after[:-1]])
            for inside, text in zip(before.tolist(), part["text"].tolist()):
                if not inside:
                    rows += given(False)
                    held, kind, first = [], 0, fresh
                fresh = False
                held.append(text)
            state = bool(after[-1])
        yield pd.DataFrame(rows, columns=columns)
    if current is not None:
        yield pd.DataFrame(given(state), columns=columns)


def _counted(table: DataFrame, label: str) -> DataFrame:
    """Staged, and broadcast where it is small by count."""
    table = stage(table, label)
    return F.broadcast(table) if table.count() <= FETCH else table


def _records(spark: SparkSession, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(``file, first, text`` of every record, files that are not UTF-8)."""
    lines = _lines(spark, path, pattern)
    ranges = stage(lines.drop("text").mapInPandas(_range_functions, "file string, range long, from_out boolean, from_in boolean, valid boolean"), "csv-ranges")
    bad = ranges.groupBy("file").agg(F.bool_and("valid").alias("valid")).where(~F.col("valid")).select("file")
    # the ranges of a file in order: each begins in the state that those before it leave
    earlier = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    folded = F.aggregate(
        F.collect_list(F.struct("from_out", "from_in")).over(earlier), F.lit(False), lambda s, r: F.when(s, r["from_in"]).otherwise(r["from_out"])
    )
    begins = _counted(ranges.select("file", "range", F.coalesce(folded, F.lit(False)).alias("begins_inside")), "csv-states")
    # streaming the larger side of a broadcast join keeps the lines in order; else they are sorted back
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    joined = numbered.join(begins, ["file", "range"])
    if ranges.count() > FETCH:
        joined = joined.repartition("file", "range").sortWithinPartitions("file", "range", "line")
    cut = stage(joined.mapInPandas(_cut, "file string, range long, kind int, first boolean, text string"), "csv-cut")
    pieces = cut.where("kind > 0")
    order = W.partitionBy("file").orderBy("range", F.desc("kind"))
    grouped = pieces.withColumn("record", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order))
    whole = grouped.groupBy("file", "record").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    return cut.where("kind = 0").select("file", "first", "text").unionByName(whole.select("file", "first", "text")), bad


def csv_rows(spark: SparkSession, path: str, pattern: str, columns: dict[str, str], name: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the CSV files below ``path`` whose name fits ``pattern``, by each file's own header.

    ``columns``: header name -> column name; a column that a file or a row lacks is null. ``name`` makes
    the ``source`` column of ``file``. Returns (rows, failed: path, error): a file that is not UTF-8, or
    that has a record which cannot be read, fails as a whole.
    """
    fields = list(columns.values())
    shape = ", ".join(f"`{c}` string" for c in ["source", *fields])
    try:
        records, bad = _records(spark, path, pattern)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape), spark.createDataFrame([], "path string, error string")
    headers = _counted(records.where("first").select("file", F.col("text").alias("header")), "csv-headers")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            out: list[Sequence] = []
            for file, header, text in zip(batch["file"], batch["header"], batch["text"]):
                try:
                    if header not in known:
                        known[header] = next(csv.reader(io.StringIO(header, newline="")), [])
                    for row in csv.reader(io.StringIO(text, newline="")):
                        if row:
                            got = dict(zip(known[header], row))
                            out.append((file, *[got.get(c) for c in columns], None))
                except csv.Error as exc:
                    out.append((file, *[None] * len(columns), str(exc)))
            yield pd.DataFrame(out, columns=["file", *fields, "error"])

    typed = ", ".join(f"`{c}` string" for c in ["file", *fields, "error"])
    parsed = stage(records.where(~F.col("first")).join(headers, "file").select("file", "header", "text").mapInPandas(parse, typed), "csv-rows")
    broken = parsed.where(F.col("error").isNotNull()).groupBy("file").agg(F.min("error").alias("error"))
    failed = bad.select("file", F.lit("not UTF-8 text").alias("error")).unionByName(broken).groupBy("file").agg(F.max("error").alias("error"))
    failed = stage(failed, "csv-failed")
    good = parsed.where(F.col("error").isNull()).join(failed.select("file"), "file", "left_anti")
    return good.select(name.alias("source"), *fields), failed.select(name.alias("path"), "error")
