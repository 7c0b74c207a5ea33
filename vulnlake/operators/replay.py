"""The similarity cache over a whole run: which findings are asked, and which answer the others get.

One at a time, a finding takes the answer of the first cache entry (in insertion order) that is
similar enough; where there is none it is asked, and its answer becomes the newest entry, which
pushes out the oldest of a full cache. So the cache before any finding is the last ``max_size``
asked findings before it (the leaders), and nothing else of the past matters.

``replay`` finds the leaders of all findings without walking through them one by one. Findings are
numbered and cut into stretches. Every stretch is replayed on its own, from the last ``max_size``
leaders before it as far as they are known; the leaders that come out give the next round's
entries. Only stretches whose entries changed are replayed again. When nothing changes, each
stretch began with the cache that the stretches before it really leave, so the result is that of
the walk: the first stretch is right after one round, and every further round settles at least
the next one. In practice a few rounds do, as leaders settle where the keys begin to repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnlake.domain import CACHE_SIZE, CACHE_THRESHOLD
from vulnlake.functions.folds import bound
from vulnlake.functions.vectors import norm
from vulnlake.operators.cache import fifo_retain
from vulnlake.operators.ranking import number_rows
from vulnlake.session import stage

STRETCH = 4096
REPLAYED = "number long, source long, similarity double"


def _walk(numbers, units, entry_numbers: list[int], entries: list[np.ndarray], threshold: float, max_size: int) -> list[tuple[int, int, float | None]]:
    """The rule itself, for one stretch: (number, number of the answering entry, similarity)."""
    width = len(units[0]) if len(units) else 0
    held = np.zeros((max_size + len(units), width))  # entries in insertion order; the live ones are [low:high]
    names = np.zeros(len(held), np.int64)
    high = len(entries)
    if high:
        held[:high], names[:high] = np.stack(entries), entry_numbers
    low, out = max(0, high - max_size), []
    for number, unit in zip(numbers, units):
        alike = held[low:high] @ unit
        reached = np.flatnonzero(alike >= threshold)
        if len(reached):
            out.append((number, int(names[low + reached[0]]), float(alike[reached[0]])))
            continue
        held[high], names[high] = unit, number
        high += 1
        low = max(low, high - max_size)
        out.append((number, number, None))
    return out


def _with_unit(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of some length, and that vector as ``unit``."""
    # the length is bound, as it would else be worked out again for every component
    unit = bound(norm(F.col(vector)), lambda n: F.when(n > 0, F.transform(F.col(vector), lambda x: x.cast("double") / n)))
    return rows.withColumn("unit", unit).where(F.col("unit").isNotNull())


def _entries(leaders: DataFrame, units: DataFrame, stretches: DataFrame, max_size: int) -> DataFrame:
    """(stretch, entries, mark): the last ``max_size`` leaders before each stretch, oldest first.

    Leaders (``stretch, number``) are ranked once over all; a stretch needs a range of ranks, found from
    the counts of the stretches before it (one row per stretch with leaders). Only these few take their ``units``.
    """
    ranked = stage(number_rows(leaders, [], [F.col("number")], "place", "leaders"), "ranked-leaders")
    counts = ranked.groupBy("stretch").agg(F.max("place").alias("last"))
    before = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    upto = stretches.select("stretch").unionByName(counts.select("stretch")).distinct().join(counts, "stretch", "left")
    upto = upto.withColumn("last", F.coalesce(F.max("last").over(before), F.lit(0)))
    places = F.when(F.col("last") > 0, F.sequence(F.greatest(F.col("last") - max_size + 1, F.lit(1)), F.col("last")))
    wanted = upto.join(stretches.select("stretch"), "stretch", "left_semi").select("stretch", F.explode(places).alias("place"))
    found = wanted.join(ranked.drop("stretch"), "place").join(units.select("number", "unit"), "number")
    held = found.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("number", "unit"))).alias("entries"))
    held = stretches.select("stretch").join(held, "stretch", "left")
    return held.withColumn("mark", F.coalesce(F.xxhash64("entries.number"), F.lit(0)))


def replay(
    asked: DataFrame,
    cache: DataFrame,
    threshold: float = CACHE_THRESHOLD,
    max_size: int = CACHE_SIZE,
    order: str = "query_id",
    vector: str = "embedding",
    stretch: int = STRETCH,
) -> DataFrame:
    """Every row of ``asked`` with the entry that answers it, as if asked one by one in ``order``.

    Adds ``number`` (0, 1, ... in order), ``source`` (the number of the row whose answer it takes;
    its own where it is asked; for an entry of ``cache``, -1 for the newest, -2 for the one before,
    ...) and ``similarity`` (null where asked). ``order`` is unique. Rows without a vector, or with a
    zero one, are asked and never become entries, as nothing can be similar to them.
    """
    numbered = stage(number_rows(asked, [], [F.col(order)], "number", "asked").withColumn("number", F.col("number") - 1), "numbered")
    rows = _with_unit(numbered, vector).select(F.floor(F.col("number") / stretch).alias("stretch"), "number", "unit")
    rows = stage(rows, "stretches")
    stretches = stage(rows.select("stretch").distinct(), "stretch-list")

    # the run's first entries: at most max_size rows
    newest = W.orderBy(F.desc("seq"))
    first = fifo_retain(cache, max_size).withColumn("number", -F.row_number().over(newest).cast("long"))
    first = stage(_with_unit(first, vector).select(F.lit(-1).cast("long").alias("stretch"), "number", "unit"), "first-entries")

    def run(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"number": [], "source": [], "similarity": []}).astype({"number": "int64", "source": "int64"})
        own = own.sort_values("number")
        entries = [] if not len(state) or state["entries"].iloc[0] is None else list(state["entries"].iloc[0])
        walked = _walk(own["number"].tolist(), [np.asarray(u) for u in own["unit"]], [e["number"] for e in entries], [np.asarray(e["unit"]) for e in entries], threshold, max_size)
        return pd.DataFrame(walked, columns=["number", "source", "similarity"]).astype({"similarity": "float64"})

    units = first.unionByName(rows)
    marks, found, leaders = None, None, first.select("stretch", "number")
    while True:
        state = stage(_entries(leaders, units, stretches, max_size), "entries")
        if marks is None:
            open_ = state
        else:
            seen = marks.select("stretch", F.col("mark").alias("seen"))
            open_ = state.join(seen, "stretch").where("mark <> seen").drop("seen")
        again = stage(open_.select("stretch"), "open-stretches")
        if again.isEmpty():
            break
        own = rows.join(again, "stretch", "left_semi")
        fresh = own.groupBy("stretch").cogroup(open_.groupBy("stretch")).applyInPandas(run, REPLAYED)
        fresh = fresh.withColumn("stretch", F.floor(F.col("number") / stretch))
        if found is not None:
            fresh = fresh.unionByName(found.join(again, "stretch", "left_anti"))
        found, marks = stage(fresh, "replayed"), state.select("stretch", "mark")
        leaders = first.select("stretch", "number").unionByName(found.where("source = number").select("stretch", "number"))
    if found is None:  # no row has a vector
        return numbered.withColumn("source", F.col("number")).withColumn("similarity", F.lit(None).cast("double"))
    out = numbered.join(found.select("number", "source", "similarity"), "number", "left")
    return out.withColumn("source", F.coalesce("source", "number"))
