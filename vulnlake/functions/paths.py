"""Path column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root`` with ``/`` separators, or null when it lies outside.

    ``root`` must match whole segments: ``/a/bc`` is not below ``/a/b``.
    """
    full = F.regexp_replace(unix_path(path), "/+", "/")
    base = F.regexp_replace(F.regexp_replace(unix_path(root), "/+", "/"), "/$", "")
    inside = full.startswith(F.concat(base, F.lit("/")))
    return F.when(inside, full.substr(F.length(base) + 2, F.length(full))).when(full == base, ".")


def segments(path: Column) -> Column:
    return F.split(unix_path(path), "/")
