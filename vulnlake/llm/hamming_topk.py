"""Exact top-k of binary codes: incremental multi-index hashing.

A code is cut into segments of 16 bits; an index lists the codes by (segment, value). In round
r every open code looks up, in each segment, the values at exactly r bits from its own. After
round r all codes within m * (r + 1) - 1 bits are known (m segments: a code further inside in
none of them would differ by at least r + 1 in each), so a code closes once its k-th verified
distance is no larger, or when every row has been found.

* Rows asking with equal codes ask once. Each indexed code is listed once, with the k + 1
  smallest ids that have it: no more of one code can be among the k nearest other rows, so a
  very common code costs one entry on either side.
* Probes of values that no row has are dropped before they are shuffled. The values present
  are at most 65,536 a segment by definition, so this list alone is broadcast; probes and index
  meet in sort-merge joins, neither side having a bound.

All rounds are joins and native expressions; state is written to the shared folder per round.

Defined cases: null vectors and vectors with null or non-finite components or of another
length take no part; ties go to the smaller id; rows that repeat an id are one row; with fewer
than k other rows all of them are returned.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.session import stage

SEGMENT = 16


def segments(vector: Column, bits: int) -> Column:
    """Sign bits of a vector as integers of SEGMENT bits, lowest component first."""
    parts = []
    for start in range(0, bits, SEGMENT):
        bit = [F.when(vector[i] > 0, F.lit(1 << (i - start))).otherwise(F.lit(0)) for i in range(start, min(start + SEGMENT, bits))]
        total = bit[0]
        for b in bit[1:]:
            total = total + b
        parts.append(total.cast("int"))
    return F.array(*parts)


def coded(vectors: DataFrame, key: str, vector: str, bits: int) -> DataFrame:
    """(id, code) of the rows that take part."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == bits) & whole)
    return rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(segments(v, bits)).alias("code"))


def _masks(radius: int, bits: int) -> Column:
    """All masks of ``radius`` set bits, as one constant array."""
    masks = (sum(1 << i for i in c) for c in combinations(range(bits), radius))
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")


def hamming(a: Column, b: Column, parts: int) -> Column:
    out = F.lit(0)
    for i in range(parts):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], bits: int, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest other rows of every query row, exactly."""
    parts = -(-bits // SEGMENT)
    rows = stage(coded(vectors, key, vector, bits), "codes")
    asking = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("code").alias("asked"))
    order = Window.partitionBy("code").orderBy("id")
    firsts = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    codes = firsts.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = stage(codes.select("code", "ids", F.posexplode("code").alias("segment", "value")), "segments")
    present = stage(index.select("segment", "value").distinct(), "values")  # at most 2 ** SEGMENT a segment
    listed = index.where("segment = 0").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]

    open_ = stage(asking.select("asked").distinct(), "asked")
    best = rows.select(F.col("code").alias("asked"), F.col("id").alias("vec_id"), F.lit(0).alias("distance")).limit(0)
    done = best
    for radius in range(SEGMENT + 1):
        own = open_.select("asked", F.posexplode("asked").alias("segment", "own"))
        probes = own.select("asked", "segment", F.explode(_masks(radius, SEGMENT)).alias("mask"), "own")
        probes = probes.select("asked", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        probes = probes.join(F.broadcast(present), ["segment", "value"], "left_semi").hint("merge")
        met = probes.join(index.hint("merge"), ["segment", "value"]).select("asked", "code", "ids").dropDuplicates(["asked", "code"])
        fresh = met.select("asked", F.explode("ids").alias("vec_id"), hamming(F.col("asked"), F.col("code"), parts).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "vec_id"))
        ranked = fresh.unionByName(best).distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
        best = stage(ranked, "nearest")
        # a row asking is among its own nearest, or k + 1 rows of its code stand before it
        covered = parts * (radius + 1) - 1
        closed = best.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        closed = stage(closed.where(((F.col("n") > k) & (F.col("far") <= covered)) | (F.col("n") >= listed)).select("asked"), "closed")
        done = done.unionByName(best.join(closed, "asked", "left_semi"))
        best = best.join(closed, "asked", "left_anti")
        open_ = stage(open_.join(closed, "asked", "left_anti"), "open")
        if open_.isEmpty():
            break
    nearest = done.unionByName(best).groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(nearest, "asked").select("query_id", F.posexplode(others).alias("place", "n"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "n.vec_id", F.col("n.distance").cast("int").alias("distance"))
