"""Shared helpers: the learning fold, bounded label samples, free column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 20  # steps of one hash in a sample
CLASSES = 1000  # values of a label that are told apart


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_share(key: Column, salt: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for a key, in steps far below one row of any table."""
    coarse, fine = (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(SPACE)) / F.lit(SPACE) for s in (salt, salt + 1_000_003))
    return coarse + fine / F.lit(SPACE)


def class_sample(rows: DataFrame, key: str, value: str, per_class: int, classes: int = CLASSES) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each value (all where fewer), and the value counts.

    Rows are chosen by a hash of the key, so the choice does not depend on partitioning
    and no row group meets in one task. Of more than ``classes`` values the most frequent are
    taken, which bounds what comes to the driver.
    """
    most = rows.where(F.col(value).isNotNull()).groupBy(value).count().orderBy(F.desc("count"), value).limit(classes).collect()
    counts = {r[value]: r["count"] for r in most}
    if not counts:
        return rows.limit(0), {}
    shares = F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, per_class / n)])
    return rows.where(hash_share(F.col(key), 17) < F.try_element_at(shares, F.col(value))), counts


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the learning fold: 0/1 labels only, the larger one where a document has several."""
    y = F.col(label).cast("int")
    return (
        labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(y).alias("y"))
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the frame has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
