"""Arrays cut and built inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128  # elements that are appended to one by one

def empty_list(element: str) -> list[Column]:
    """Two fields of a fold's state, ``block`` and ``blocks``: an empty list of ``element`` (an SQL type).

    Appending to one array copies it each time. Rows are gathered in a block of bounded size, and
    full blocks in a list. A fold's state is copied at every step all the same, so this is for lists
    that are short beside what is folded.
    """
    return [F.array().cast(f"array<{element}>").alias("block"), F.array().cast(f"array<array<{element}>>").alias("blocks")]


def appended(state: Column, items: Column) -> list[Column]:
    """The two fields after an array of items was appended."""
    full = F.size(state["block"]) >= BLOCK
    return [
        F.when(full, items).otherwise(F.concat(state["block"], items)).alias("block"),
        F.when(full, F.concat(state["blocks"], F.array(state["block"]))).otherwise(state["blocks"]).alias("blocks"),
    ]


def whole_list(state: Column) -> Column:
    return F.flatten(F.concat(state["blocks"], F.array(state["block"])))


def runs(rows: Column, starts) -> Column:
    """An array cut before each element that ``starts`` holds for: an array of arrays, in linear time.

    The first run begins with the first element in any case; an empty or null array has none.
    """

    def cut(rows: Column) -> Column:
        at = F.filter(F.transform(rows, lambda r, i: F.when((i == 0) | starts(r), i)), lambda i: i.isNotNull())
        return bound(at, lambda at: F.transform(at, lambda a, k: F.slice(rows, a + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - a)))

    return bound(rows, cut)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]
