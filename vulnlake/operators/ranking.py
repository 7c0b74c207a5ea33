"""Top-k per key (K1) and numbering that does not gather a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake.session import stage


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """K1: the first ``k`` rows per key in the given order, numbered from 1.

    End ``order`` with a unique column to settle ties. Spark cuts each partition to
    ``k`` rows per key before the shuffle (window group limit), so a hot key moves
    ``k`` rows per task and no more.
    """
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, label: str = "numbered"
) -> DataFrame:
    """``row_number`` per key for keys that may be far too large for one task.

    The rows are range-sorted by key and order, so a hot key spreads over many
    partitions. The sorted table is staged with each row's partition and position;
    the number is the position within the partition's run of that key plus the
    number of rows the key has in earlier partitions (a table of one row per key and
    partition). End ``order`` with a unique column.
    """
    keys = [F.col(c) for c in by]
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = stage(placed, label)
    runs = placed.groupBy(*by, "_part").agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n")
    )
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [placed[c].eqNullSafe(F.col(f"_run_{c}")) for c in [*by, "_part"]]
    renamed = runs.withColumnsRenamed({c: f"_run_{c}" for c in [*by, "_part"]})
    return placed.join(renamed, same).select(
        *df.columns, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias(name)
    )
