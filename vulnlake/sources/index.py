"""Persisted index: chunks, postings in blocks, vectors in blocks, and a manifest that names them.

Below the index folder::

    parts/<id>/{chunks,forward,blocks,vectors}   what one write added, never changed afterwards
    terms/<id>, pivots/<id>                      whole vocabulary and pivots as of one version
    manifest/v=<number>                          one row: the parts and tables of that version

A version exists when its manifest row does, which is the last thing a write does; readers take the
highest one. So an index is always whole: its chunks, postings and vectors belong together,
and a write that failed leaves the version before it. Opening derives nothing: tables are read
where they lie, and only the manifest row and the pivots come to the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vulnlake.operators.bm25 import Index
from vulnlake.operators.postings import forward_table, gain_of, merged_terms, posting_blocks, term_table, weighted_terms
from vulnlake.operators.vectors import Pivots, VectorIndex, choose_pivots, unit_rows, vector_blocks
from vulnlake.session import stage

MANIFEST = "parts array<string>, schemas array<string>, terms string, pivots string, n bigint, total_length bigint, avg_idf double, v int"
PIVOTS = "cluster int, unit binary, of_group int, size bigint, low double, high double, group_unit binary, group_low double, group_high double"


@dataclass(frozen=True)
class StoredIndex:
    """One version of an index. ``bm25`` is None where it has no chunks, ``vectors`` where none has a vector."""

    version: int
    chunks: DataFrame
    bm25: Index | None
    vectors: VectorIndex | None


def _manifest(spark: SparkSession, path: str) -> Row | None:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows.orderBy(F.desc("v")).first()


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").partitionBy("v").parquet(f"{path}/manifest")


def _stored_pivots(spark: SparkSession, path: str) -> Pivots | None:
    """Pivots of a version: as many rows as the root of the index's rows, over a constant."""
    rows = spark.read.schema(PIVOTS).parquet(path).orderBy("cluster").collect()
    if not rows:
        return None
    groups = {r["of_group"]: r for r in rows}
    heads = [groups[g] for g in sorted(groups)]
    stack = lambda name, of: np.stack([np.frombuffer(r[name]) for r in of])
    column = lambda name, of: np.array([r[name] for r in of])
    return Pivots(
        stack("unit", rows), column("of_group", rows), column("size", rows), column("low", rows), column("high", rows),
        stack("group_unit", heads), column("group_low", heads), column("group_high", heads),
    )


def _store_pivots(spark: SparkSession, p: Pivots | None, path: str) -> None:
    rows = [] if p is None else [
        (c, p.units[c].tobytes(), int(g), int(p.size[c]), float(p.low[c]), float(p.high[c]), p.group_units[g].tobytes(), float(p.group_low[g]), float(p.group_high[g]))
        for c, g in enumerate(p.group)
    ]
    spark.createDataFrame(rows, PIVOTS).coalesce(1).write.parquet(path)


def _joined(before: Pivots, more: Pivots) -> Pivots:
    """The same directions with the rows of both."""
    held, new = before.size > 0, more.size > 0
    low = np.where(held & new, np.minimum(before.low, more.low), np.where(held, before.low, more.low))
    return Pivots(
        before.units, before.group, before.size + more.size, low, np.maximum(before.high, more.high), before.group_units,
        np.minimum(before.group_low, more.group_low), np.maximum(before.group_high, more.group_high),
    )


def _add_part(chunks: DataFrame, path: str, before: Row | None) -> None:
    """Write a part of ``chunks`` beside those of ``before`` (None: as the only one) and make it a version."""
    spark = chunks.sparkSession
    part = uuid.uuid4().hex
    folder = f"{path}/parts/{part}"
    latest = _manifest(spark, path)
    chunks.write.partitionBy("doc_type").parquet(f"{folder}/chunks")
    chunks = spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
    forward_table(chunks).write.parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    posting_blocks(forward).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    terms = term_table(blocks)
    if before is not None:
        terms = merged_terms(terms.unionByName(spark.read.parquet(f"{path}/{before['terms']}").select(*terms.columns)))
    sizes = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    n, total = sizes["n"] + (before["n"] if before else 0), sizes["total"] + (before["total_length"] if before else 0)
    avgdl = F.lit(total / n if n else None).cast("double")
    terms = stage(terms, "terms")
    avg_idf = terms.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
    weighted = weighted_terms(terms, F.lit(n), avgdl)
    weighted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms/{part}")
    pivots = None
    if "embedding" in chunks.columns:
        units = stage(unit_rows(chunks), "vector-units")
        pivots = _stored_pivots(spark, f"{path}/{before['pivots']}") if before is not None else None
        known = pivots is not None
        pivots = pivots if known else choose_pivots(units)
        if pivots is not None:
            rows, shape = vector_blocks(units, pivots)
            rows.repartitionByRange("cluster", "shard").sortWithinPartitions("cluster").write.parquet(f"{folder}/vectors")
            pivots = _joined(pivots, shape) if known else shape
    _store_pivots(spark, pivots, f"{path}/pivots/{part}")
    parts = [part, *(before["parts"] if before else [])]
    schemas = [chunks.schema.json(), *(before["schemas"] if before else [])]
    version = latest["v"] + 1 if latest else 1
    _commit(spark, path, (parts, schemas, f"terms/{part}", f"pivots/{part}", n, total, avg_idf, version))


def write_index(chunks: DataFrame, path: str, rebuild: bool = False) -> None:
    """Store chunks (``chunk_id, content, doc_type, ...`` with their embedding) and their index.

    An existing index is only replaced when ``rebuild`` is set: the new version has the new part
    alone. Parts of earlier versions stay until the folder is cleared, for readers that opened them.
    """
    if not rebuild and _manifest(chunks.sparkSession, path) is not None:
        raise FileExistsError(f"INDEX_ALREADY_EXISTS: {path}")
    _add_part(chunks, path, None)


def append_index(chunks: DataFrame, path: str) -> None:
    """Add chunks with new ids to an index; the parts that are there are not written again.

    Vocabulary, mean length and pivot ranges are brought up to date. Vectors go to the pivots
    chosen at the first write: results stay exact however many are added, but an index that
    has grown many times over is searched faster after a rebuild.
    """
    spark = chunks.sparkSession
    before = _manifest(spark, path)
    if before is None:
        return write_index(chunks, path)
    held = _chunks(spark, path, before)
    if not chunks.select("chunk_id").join(held.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
        raise ValueError("some chunk ids are in the index already")
    _add_part(chunks, path, before)


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _read(spark: SparkSession, path: str, parts: list[str], table: str) -> DataFrame:
    return _united([spark.read.parquet(f"{path}/parts/{p}/{table}") for p in reversed(parts)])


def _chunks(spark: SparkSession, path: str, version: Row) -> DataFrame:
    parts = list(zip(version["parts"], version["schemas"], strict=True))
    return _united([spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/parts/{p}/chunks") for p, schema in reversed(parts)])


def _existing(spark: SparkSession, path: str, parts: list[str], table: str) -> list[str]:
    def there(part: str) -> bool:
        try:
            spark.read.schema("x int").parquet(f"{path}/parts/{part}/{table}")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    return [p for p in parts if there(p)]


def open_index(spark: SparkSession, path: str) -> StoredIndex | None:
    """The latest version of the index at ``path``; None where there is none."""
    version = _manifest(spark, path)
    if version is None:
        return None
    parts, n = version["parts"], version["n"]
    chunks = _chunks(spark, path, version)
    if n == 0:
        return StoredIndex(version["v"], chunks, None, None)
    blocks, forward = _read(spark, path, parts, "blocks"), _read(spark, path, parts, "forward")
    terms = spark.read.parquet(f"{path}/{version['terms']}")
    mean = F.lit(version["total_length"] / n)
    rows = blocks.select("term", F.explode(F.arrays_zip("chunk_ids", "tfs", "lengths")).alias("_p"))
    postings = rows.select(
        "term", F.col("_p.chunk_ids").alias("chunk_id"), F.col("_p.tfs").alias("tf"), F.col("_p.lengths").alias("length"),
        gain_of(F.col("_p.tfs"), F.col("_p.lengths"), mean).alias("gain"),
    )
    stats = spark.range(1).select(F.lit(n).alias("n"), mean.alias("avgdl"), F.lit(version["avg_idf"]).alias("avg_idf"))
    bm25 = Index(postings, terms.select("term", "df", "idf", "top_gain"), forward.select("chunk_id", "length"), stats, blocks, forward)
    pivots = _stored_pivots(spark, f"{path}/{version['pivots']}")
    vectors = None
    if pivots is not None:
        vectors = VectorIndex(_read(spark, path, _existing(spark, path, parts, "vectors"), "vectors"), pivots)
    return StoredIndex(version["v"], chunks, bm25, vectors)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame | None, Index | None]:
    """Stored chunks and their BM25 index; (None, None) without an index, (chunks, None) for an empty one."""
    stored = open_index(spark, path)
    return (None, None) if stored is None else (stored.chunks, stored.bm25)
