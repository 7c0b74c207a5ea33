"""Find snippets in source files: line windows, blocks, exact and fuzzy location."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.domain import FUZZY_THRESHOLD, SEARCH_RADIUS
from vulnlake.functions.folds import appended, empty_list, whole_list
from vulnlake.functions.similarity import ratio_bound, sequence_ratio_above
from vulnlake.functions.text import indent_of, is_blank, lines_of, lstrip, strip
from vulnlake.operators.ranking import number_rows, top_k

_BLOCK_LINES = 64


def patchable(fixes: DataFrame, file: str = "path") -> DataFrame:
    """fixes with a file, a snippet and a suggested fix."""
    return fixes.where(
        (F.length(file) > 0) & (F.length("snippet") > 0) & (F.length("suggested_fix") > 0)
    )


def group_fixes(fixes: DataFrame, file: str = "path", line: str = "line", fix_id: str = "fix_id") -> DataFrame:
    """A8 + K5: fixes numbered per file from the last line upwards -> ``fix_order``.

    A missing line counts as 0, fixes without a file are dropped. The numbering does not
    gather a file's fixes in one task.
    """
    known = fixes.where(F.length(file) > 0).withColumn("_line", F.coalesce(F.col(line), F.lit(0)))
    return number_rows(known, [file], [F.desc("_line"), F.col(fix_id)], "fix_order", "file-fixes").drop("_line")


def source_lines(text: Column) -> Column:
    """Lines of a file; a final newline does not start another line."""
    return lines_of(F.regexp_replace(text, r"\n\z", ""))


def line_windows(files: DataFrame, n: int, key: str = "path", text: str = "content") -> DataFrame:
    """Every ``n`` consecutive lines of a file -> ``start, window``; built in the row."""
    lined = files.select(key, source_lines(F.col(text)).alias("_lines"))
    starts = F.when(F.size("_lines") >= n, F.sequence(F.lit(1), F.size("_lines") - (n - 1)))
    return lined.select(key, "_lines", F.explode(starts).alias("start")).select(
        key, "start", F.array_join(F.slice("_lines", F.col("start"), F.lit(n)), "\n").alias("window")
    )


def block_extent(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """First and last line of every ``def``/``class`` block -> ``start, end``.

    A block ends before the next non-blank line indented no deeper than its head;
    trailing blank lines do not belong to it. One pass over the lines in the row of the file:
    the open heads stand on a stack, each indented deeper than the one below it, and a line
    closes those that it is not indented deeper than.
    """
    code = F.filter(
        F.transform(
            source_lines(F.col(text)),
            lambda line, i: F.struct(
                (i + 1).alias("no"),
                indent_of(line).alias("indent"),
                is_blank(line).alias("blank"),
                lstrip(line).rlike("^(def|class) ").alias("head"),
            ),
        ),
        lambda r: ~r["blank"],
    )

    def closed(heads: Column, last: Column) -> Column:
        return F.transform(heads, lambda h: F.struct(h["no"].alias("start"), last.alias("end")))

    def step(state: Column, r: Column) -> Column:
        ended = F.filter(state["open"], lambda h: h["indent"] >= r["indent"])
        left = F.filter(state["open"], lambda h: h["indent"] < r["indent"])
        own = F.array(F.struct(r["no"].alias("no"), r["indent"].alias("indent")))
        stays = F.size(state["open"]) == F.size(left)
        block, blocks = appended(state, closed(ended, state["last"]))
        return F.struct(
            F.when(r["head"], F.concat(left, own)).otherwise(left).alias("open"),
            r["no"].alias("last"),
            F.when(stays, state["block"]).otherwise(block).alias("block"),
            F.when(stays, state["blocks"]).otherwise(blocks).alias("blocks"),
        )

    start = F.struct(F.array().cast("array<struct<no:int,indent:int>>").alias("open"), F.lit(0).alias("last"), *empty_list("struct<start:int,end:int>"))
    found = F.aggregate(code, start, step, lambda s: F.concat(whole_list(s), closed(s["open"], s["last"])))
    return files.select(key, F.explode(found).alias("_b")).select(key, "_b.start", "_b.end")


def normalise_code(code: Column) -> Column:
    """Comparison form of code: two blanks before a comment are one, one line, trimmed."""
    return strip(F.replace(F.replace(code, F.lit("  # "), F.lit(" # ")), F.lit("\n"), F.lit(" ")))


def _candidates(fixes: DataFrame, files: DataFrame, radius: int) -> DataFrame:
    """Fixes with the windows near their line: ``windows array<struct<start, text>>``.

    Files are cut into blocks of lines that overlap by as much as a search range needs, so a
    fix meets the one block in which its range begins, by (path, width, block). Neither a long
    file nor a file with very many fixes is ever copied whole to each fix. Blocks of long
    snippets are wider, by powers of two, so the overlap of a width is a few times its lines.
    """
    at = F.coalesce(F.col("line"), F.lit(1))
    wanted = (
        fixes.withColumn("_n", F.size(lines_of(F.col("snippet"))))
        .withColumns({"_first": F.greatest(at - radius, F.lit(1)), "_last": at + radius})
        .where(F.col("_last") >= 1)
        .withColumn("_width", F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2("_n"))).cast("int"), F.lit(_BLOCK_LINES)))
        .withColumn("block", F.floor((F.col("_first") - 1) / F.col("_width")).cast("int"))
    )
    widths = wanted.groupBy("path").agg(F.collect_set("_width").alias("_widths"))
    lined = files.join(widths, "path").select("path", F.explode("_widths").alias("_width"), source_lines(F.col("content")).alias("_lines"))
    blocks = lined.select(
        "path",
        "_width",
        F.size("_lines").alias("file_lines"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("_lines"), F.col("_width")),
                lambda first: F.slice("_lines", first, 2 * (F.col("_width") + radius)),
            )
        ).alias("block", "_region"),
    )
    regions = (
        wanted.join(blocks, ["path", "_width", "block"])
        .withColumns(
            {
                "_offset": F.col("block") * F.col("_width"),
                "_stop": F.least(F.col("_last"), F.col("file_lines") - F.col("_n") + 1),
            }
        )
        .where(F.col("_stop") >= F.col("_first"))
    )
    windows = F.transform(
        F.sequence("_first", "_stop"),
        lambda s: F.struct(
            s.alias("start"),
            F.array_join(F.slice("_region", s - F.col("_offset"), F.col("_n")), "\n").alias("text"),
        ),
    )
    return regions.select("fix_id", "path", "line", "snippet", F.col("_n").alias("n_lines"), windows.alias("windows"))


def _hashes(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal for equal texts, and for no others in practice (128 bits)."""
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("window"), text).alias("_h2")]


def _window_hashes(files: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """``path, _n, _start, _h1, _h2`` of every window of the line counts that a file's fixes need.

    Texts stay where they are read: a window leaves the row of its file as two hashes.
    """
    lined = files.join(sizes, "path").select("path", "_sizes", source_lines(F.col("content")).alias("_lines"))
    lined = lined.select("path", "_lines", F.explode("_sizes").alias("_n")).where(F.size("_lines") >= F.col("_n"))
    starts = F.sequence(F.lit(1), F.size("_lines") - F.col("_n") + 1)

    def hashed(at: Column) -> Column:
        window = normalise_code(F.array_join(F.slice("_lines", at, F.col("_n")), "\n"))
        return F.struct(at.alias("_start"), *_hashes(window))

    found = lined.select("path", "_n", F.explode(F.transform(starts, hashed)).alias("_w"))
    return found.select("path", "_n", "_w.*").withColumn("_stretch", F.floor(F.col("_start") / width))


def locate_exact(fixes: DataFrame, files: DataFrame, radius: int = SEARCH_RADIUS) -> DataFrame:
    """Lowest line within ``radius`` of the target where the snippet stands.

    Reads ``fix_id, path, line, snippet`` and ``path, content``; one row per located fix
    with ``start, n_lines``.

    Fixes and windows meet by hashes of their comparison form, so no text travels. The key holds
    the stretch of lines too (as wide as a search range, which meets two at most): lines that
    repeat through a long file, and fixes that look for them, meet only those nearby.
    """
    width = 2 * radius + 1
    wanted = normalise_code(F.col("snippet"))
    asked = fixes.where(wanted != "").select(
        "fix_id", "path", "line", F.size(lines_of(F.col("snippet"))).alias("_n"),
        F.coalesce(F.col("line"), F.lit(1)).alias("_at"), *_hashes(wanted),
    ).where(F.col("_at") + radius >= 1)
    sizes = asked.groupBy("path").agg(F.collect_set("_n").alias("_sizes"))
    stretches = F.array_distinct(F.array(*[F.floor(F.greatest(F.col("_at") + r, F.lit(1)) / width) for r in (-radius, radius)]))
    spread = asked.withColumn("_stretch", F.explode(stretches))
    met = spread.join(_window_hashes(files, sizes, width), ["path", "_n", "_h1", "_h2", "_stretch"])
    near = met.where(F.abs(F.col("_start") - F.col("_at")) <= radius)
    found = near.groupBy("fix_id").agg(F.min("_start").alias("start"), *[F.first(c).alias(c) for c in ("path", "line", "_n")])
    return found.select("fix_id", "path", "line", "start", F.col("_n").alias("n_lines"))


def locate_fuzzy(
    fixes: DataFrame,
    files: DataFrame,
    radius: int = SEARCH_RADIUS,
    threshold: float = FUZZY_THRESHOLD,
    similarity: Callable[[Column, Column], Column] | None = None,
    bound: Callable[[Column, Column], Column] | None = ratio_bound,
) -> DataFrame:
    """For fixes without an exact place, the most similar window at or above
    ``threshold``, the earliest of equals -> ``start, n_lines, ratio``.

    ``similarity`` is the stdlib matcher unless given. ``bound`` caps the similarity
    cheaply, so most windows never reach it.
    """
    if similarity is None:
        similarity = sequence_ratio_above(threshold)
    missed = _candidates(fixes.join(locate_exact(fixes, files, radius).select("fix_id"), "fix_id", "left_anti"), files, radius)
    pairs = missed.select(
        "fix_id", "path", "line", "n_lines",
        # no window is missing; of the plain form Spark would build the windows twice, to see whether there are any
        strip(F.col("snippet")).alias("_a"), F.explode_outer("windows").alias("_w"),
    ).withColumn("_b", strip(F.col("_w.text")))
    if bound is not None:
        pairs = pairs.where(bound(F.col("_a"), F.col("_b")) >= threshold)
    # a pair is slow and its row small, so the pairs are dealt to tasks that adaptive execution keeps
    tasks = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("fix_id", "path", "line", "n_lines", F.col("_w.start").alias("start"), "_a", "_b").repartition(tasks, "fix_id", "start")
    scored = pairs.select(
        "fix_id", "path", "line", "n_lines", "start", similarity(F.col("_a"), F.col("_b")).alias("ratio")
    )
    # the threshold comes after the choice, as Spark would move it, and the similarity, before the shuffle
    best = top_k(scored, ["fix_id"], [F.desc("ratio"), F.col("start")], 1, rank="_nth")
    return best.where(F.col("ratio") >= threshold).drop("_nth")


def reindent(code: Column, base: Column) -> Column:
    """Shift code so that its shallowest line has ``base`` blanks; blank lines empty."""
    lines = lines_of(code)
    depths = F.transform(F.filter(lines, lambda line: ~is_blank(line)), indent_of)
    least = F.coalesce(F.array_min(depths), F.lit(0))
    shifted = F.transform(
        lines,
        lambda line: F.when(is_blank(line), F.lit("")).otherwise(
            F.concat(F.repeat(F.lit(" "), (base + indent_of(line) - least).cast("int")), lstrip(line))
        ),
    )
    return F.array_join(shifted, "\n")


def is_import(line: Column) -> Column:
    return lstrip(line).startswith("import ") | lstrip(line).startswith("from ")


def imports_of(code: Column) -> Column:
    """Distinct import lines, trimmed and sorted."""
    found = F.filter(lines_of(code), is_import)
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def without_imports(code: Column) -> Column:
    """The code without its import lines, blank lines at both ends removed."""
    kept = F.array_join(F.filter(lines_of(code), lambda line: ~is_import(line)), "\n")
    ws = r"[\s\x1c-\x1f\x85\xa0]"
    return F.regexp_replace(F.regexp_replace(kept, rf"^(?:{ws}*\n)+", ""), rf"\n{ws}*\z|\A{ws}+\z", "")


def file_imports(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """``(path, import_line)`` of every file."""
    return files.select(key, F.explode(imports_of(F.col(text))).alias("import_line"))


def missing_imports(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """Import lines that a file's fixes need and the file lacks.

    Both sides are distinct (path, line) pairs, so many fixes of one file are cheap.
    """
    needed = fixes.select("path", F.explode(imports_of(F.col("suggested_fix"))).alias("import_line")).distinct()
    return needed.join(file_imports(files), ["path", "import_line"], "left_anti")


def import_anchor(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Number of lines above the place for new imports -> ``anchor``.

    That is after the last import of the first import block, or without imports before
    the first line that is neither blank, comment nor docstring quote.
    """
    rows = F.transform(
        lines_of(F.col(text)),
        lambda line, i: F.struct(
            (i + 1).alias("no"),
            is_import(line).alias("imp"),
            (is_blank(line) | lstrip(line).startswith("#")).alias("soft"),
            lstrip(line).rlike("^(\"\"\"|''')").alias("quote"),
        ),
    )
    table = files.select(key, rows.alias("_rows"))
    number = lambda kept: F.transform(kept, lambda r: r["no"])
    table = table.withColumn("_first", F.array_min(number(F.filter("_rows", lambda r: r["imp"]))))
    table = table.withColumn(
        "_stop",
        F.array_min(number(F.filter("_rows", lambda r: (r["no"] > F.col("_first")) & ~r["imp"] & ~r["soft"]))),
    )
    last = F.array_max(
        number(F.filter("_rows", lambda r: r["imp"] & (F.col("_stop").isNull() | (r["no"] < F.col("_stop")))))
    )
    code = F.array_min(number(F.filter("_rows", lambda r: ~r["soft"] & ~r["quote"])))
    return table.select(key, F.coalesce(last, code - 1, F.lit(0)).alias("anchor"))
