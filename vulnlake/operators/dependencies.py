"""Dependencies and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import any_lines_of, parse_requirement, pick_version, strip
from vulnlake.functions.versions import package_key, version_key
from vulnlake.operators.ranking import number_rows
from vulnlake.session import stage

STRETCH = 64  # versions of a package that a range meets together

def parse_requirements(
    files: DataFrame, file: str = "file", text: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """Pinned lines of text manifests -> ``(file, package, version)``.

    Only lines with ``==`` count. A line with more than one goes to the second frame.
    """
    line = F.col("_line")
    pinned = (
        files.select(file, F.posexplode(any_lines_of(F.col(text))).alias("_no", "_raw"))
        .select(file, (F.col("_no") + 1).alias("line"), strip(F.col("_raw")).alias("_line"))
        .where(line.contains("=="))
        .withColumn("_parts", F.split(line, "=="))
    )
    good = pinned.where(F.size("_parts") == 2).select(
        file,
        strip(F.col("_parts")[0]).alias("package"),
        strip(F.col("_parts")[1]).alias("version"),
    )
    bad = pinned.where(F.size("_parts") != 2).select(
        file, "line", F.concat(F.lit("more than one == in: "), line).alias("error")
    )
    return good, bad


def parse_specs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """P8 + P9: requirement texts -> ``package, version`` (nulls when there is none)."""
    parsed = specs.withColumn("_req", parse_requirement(F.col(spec)))
    return (
        parsed.withColumn("package", F.col("_req.name"))
        .withColumn("version", pick_version(F.col("_req.specs")))
        .drop("_req")
    )


def range_keys(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advisory ranges with comparable bounds; ranges with an unreadable bound apart.

    ``introduced`` null or ``0`` means from the first version on.
    """
    from_start = F.coalesce(F.col("introduced"), F.lit("0")) == "0"
    keyed = ranges.withColumns(
        {
            "_lo": F.when(~from_start, version_key(F.col("introduced"))),
            "_hi": version_key(F.col("fixed")),
            "_last": version_key(F.col("last_affected")),
        }
    )
    unreadable = (
        (~from_start & F.col("_lo").isNull())
        | (F.col("fixed").isNotNull() & F.col("_hi").isNull())
        | (F.col("last_affected").isNotNull() & F.col("_last").isNull())
    )
    return keyed.where(~unreadable), keyed.where(unreadable).select(*ranges.columns)


def unreadable_versions(deps: DataFrame, version: str = "version") -> DataFrame:
    """Dependencies whose version text cannot be ordered, with an ``error``."""
    ver = F.col(version)
    return deps.where(ver.isNotNull() & version_key(ver).isNull()).withColumn(
        "error", F.concat(F.lit("not a version: "), ver)
    )


def unmatched(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """What matching leaves out: ``kind, package, text, error`` of pins and ranges that cannot be ordered."""
    pins = unreadable_versions(deps).select(F.lit("pin").alias("kind"), "package", F.col("version").alias("text"), "error")
    bounds = F.concat_ws(", ", "introduced", "fixed", "last_affected")
    bad = range_keys(ranges)[1].select(F.lit("range").alias("kind"), "package", bounds.alias("text"), F.concat(F.lit("not a version in: "), bounds).alias("error"))
    return pins.unionByName(bad)


def match_advisories(deps: DataFrame, ranges: DataFrame, ecosystem: str = "PyPI") -> DataFrame:
    """J1 + F8: dependencies with at least one advisory, plus ``cves array<string>``.

    The range test runs once per distinct (package, version): a package that a third
    of all manifests pin shrinks to its few versions before the join, and the result
    goes back to the dependency rows by (package, version).

    A package's versions are put in order and cut into stretches of ``STRETCH``. A range becomes one
    row for each stretch that it reaches, and meets the versions of that stretch alone: all
    but its first and last stretch lie wholly inside, so the pairs looked at are not many more
    than the pins, the ranges and the matches, however many versions and ranges a package has.
    """
    keyed, _ = range_keys(ranges.where(F.lower("ecosystem") == ecosystem.lower()))
    bounds = keyed.select(
        package_key(F.col("package")).alias("_pkg"), "vuln_id", "_lo", "_hi", "_last"
    )
    wanted = deps.select(
        package_key(F.col("package")).alias("_pkg"), F.col("version").alias("_ver")
    )
    # stored, as the filter on the key would else move below the distinct and order every row's version
    pins = stage(wanted.where(F.col("_pkg").isNotNull() & F.col("_ver").isNotNull()).distinct(), "distinct-pins")
    pins = pins.withColumn("_key", version_key(F.col("_ver"))).where(F.col("_key").isNotNull())
    ordered = number_rows(pins, ["_pkg"], [F.col("_key"), F.col("_ver")], "_nth", "pins")
    ordered = ordered.withColumn("_stretch", F.floor((F.col("_nth") - 1) / STRETCH).cast("int"))
    firsts = ordered.groupBy("_pkg", "_stretch").agg(F.min("_key").alias("_first"))
    firsts = firsts.groupBy("_pkg").agg(F.sort_array(F.collect_list(F.struct("_stretch", "_first"))).alias("_s"))
    firsts = firsts.select("_pkg", F.transform("_s", lambda x: x["_first"]).alias("_firsts"))

    def before(bound: str, inclusive: bool) -> Column:
        """Number of stretches that begin before a bound; null without one."""
        reached = F.filter("_firsts", lambda f: (f <= F.col(bound)) if inclusive else (f < F.col(bound)))
        return F.when(F.col(bound).isNotNull(), F.size(reached))

    # equal versions may stand on both sides of a cut, so a range begins at the stretch before its bound
    low = F.greatest(F.coalesce(before("_lo", False) - 1, F.lit(0)), F.lit(0))
    high = F.least(F.size("_firsts"), before("_hi", False), before("_last", True)) - 1
    reach = bounds.join(firsts, "_pkg").withColumns({"_from": low, "_to": high}).where("_to >= _from")
    reach = reach.select("_pkg", "vuln_id", "_lo", "_hi", "_last", F.explode(F.sequence("_from", "_to")).alias("_stretch"))
    inside = (
        (F.col("_lo").isNull() | (F.col("_key") >= F.col("_lo")))
        & (F.col("_hi").isNull() | (F.col("_key") < F.col("_hi")))
        & (F.col("_last").isNull() | (F.col("_key") <= F.col("_last")))
    )
    hits = (
        ordered.join(reach, ["_pkg", "_stretch"])
        .where(inside)
        .groupBy("_pkg", "_ver")
        .agg(F.array_sort(F.collect_set("vuln_id")).alias("cves"))
    )
    return (
        deps.withColumn("_pkg", package_key(F.col("package")))
        .withColumn("_ver", F.col("version"))
        .join(hits, ["_pkg", "_ver"])
        .drop("_pkg", "_ver")
    )
