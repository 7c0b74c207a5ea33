"""Version ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake.functions.folds import bound

# --- Fixed values: release phases in order --------------------------------
PHASE_DEV, PHASE_ALPHA, PHASE_BETA, PHASE_RC, PHASE_FINAL, PHASE_POST = 0, 1, 2, 3, 4, 5
NO_MORE_PARTS = -1
_VERSION = (
    r"^\s*[vV]?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?([A-Za-z]+)[-_.]?(\d*))?(?:-(\d+))?"
    r"(?:[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+[A-Za-z0-9._-]+)?\s*$"
)
# ---------------------------------------------------------------------------


def version_key(version: Column) -> Column:
    """Version text as ``array<bigint>`` that compares like the version does.

    Layout: epoch, release parts without trailing zeros, -1, phase, phase number, post
    number, dev number. Arrays compare element by element and -1 is below any part, so
    releases of any length compare, and ``1.0`` and ``1.0.0`` get the same key. Local
    labels are ignored. Text that is not a version, or holds a number beyond 64 bits
    anywhere, gives null.
    """
    # One regex pass: the groups, separated by a bar, in a fixed order.
    groups = F.split(
        F.regexp_replace(F.lower(version), _VERSION, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|", -1
    )
    # bound, as every mention of the groups and of the numbers would else be worked out anew
    return F.when(F.lower(version).rlike(_VERSION), bound(groups, lambda g: bound(_numbers(g), lambda n: _key(g, n))))


def _numbers(groups: Column) -> Column:
    return F.transform(F.split(F.get(groups, F.lit(1)), r"\."), lambda part: part.try_cast("bigint"))


def _key(groups: Column, numbers: Column) -> Column:
    """Key of a version text from its groups and its release parts as numbers."""

    def group(i: int) -> Column:
        return F.get(groups, F.lit(i - 1))

    # the last part that is not zero ends the release
    used = F.coalesce(F.array_max(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1))), F.lit(0))
    parts = F.slice(numbers, F.lit(1), used)

    def number(i: int) -> Column:
        return F.coalesce(group(i).try_cast("bigint"), F.lit(0).cast("bigint"))

    def oversize(i: int) -> Column:
        return (group(i) != "") & group(i).try_cast("bigint").isNull()

    label = group(3)
    dash_post = group(5) != ""
    is_post_label = label.isin("post", "rev", "r")
    has_post = dash_post | is_post_label | (group(6) != "")
    is_dev_label = label == "dev"
    has_dev = is_dev_label | (group(8) != "")
    pre = (
        F.when(label.isin("a", "alpha"), PHASE_ALPHA)
        .when(label.isin("b", "beta"), PHASE_BETA)
        .when(label.isin("c", "rc", "pre", "preview"), PHASE_RC)
    )
    known = (label == "") | pre.isNotNull() | is_post_label | is_dev_label
    phase = (
        F.when(pre.isNotNull(), pre)
        .when(has_post, PHASE_POST)
        .when(has_dev, PHASE_DEV)
        .otherwise(PHASE_FINAL)
    )
    post = (
        F.when(dash_post, number(5) + 1)
        .when(is_post_label, number(4) + 1)
        .when(has_post, number(7) + 1)
        .otherwise(0)
    )
    # A dev release sorts below the same release without the dev part.
    no_dev = F.lit(2**63 - 1)
    dev = F.when(is_dev_label, number(4)).when(has_dev, number(9)).otherwise(no_dev)
    key = F.concat(
        F.array(number(1)),
        parts,
        F.array(F.lit(NO_MORE_PARTS).cast("bigint"), phase.cast("bigint"), F.when(pre.isNotNull(), number(4)).otherwise(0), post, dev),
    )
    valid = (
        known
        & ~F.exists(numbers, lambda n: n.isNull())
        & ~(oversize(1) | oversize(4) | oversize(5) | oversize(7) | oversize(9))
    )
    return F.when(valid, key)


def package_key(name: Column) -> Column:
    """Package name folded so that case and ``-_.`` runs do not matter."""
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")
