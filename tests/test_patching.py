import ast
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vulnlake.functions.similarity import levenshtein_ratio, ratio_bound, sequence_ratio
from vulnlake.operators import changes as ch, locating as lc, patching as pt
from vulnlake.plans.changes import prepare_changes

FIX = "fix_id int, path string, line int, snippet string, suggested_fix string"


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content string")


def patch(spark, content, *fixes):
    rows = [(i, "f", *fix) for i, fix in enumerate(fixes)]
    out = pt.patch_files(files(spark, f=content), spark.createDataFrame(rows, FIX)).collect()
    done = next(r for r in out if r.kind == "file")
    return done.content, done.n_applied, done.n_failed


def test_single_and_bottom_up(spark):
    text = "a = 1\nb = 2\nc = 3\n"
    assert patch(spark, text, (2, "b = 2", "b = 20\nbb = 21")) == ("a = 1\nb = 20\nbb = 21\nc = 3\n", 1, 0)
    assert patch(spark, text, (1, "a = 1", "a = 10\nx = 0"), (3, "c = 3", "c = 30")) == ("a = 10\nx = 0\nb = 2\nc = 30\n", 2, 0)


def test_indent_is_kept(spark):
    text = "class A:\n    def f(self):\n        x = eval(y)\n        return x\n"
    got, _, _ = patch(spark, text, (3, "x = eval(y)", "if y:\n    x = int(y)"))
    assert got == "class A:\n    def f(self):\n        if y:\n            x = int(y)\n        return x\n"


def test_fuzzy_and_missing(spark):
    text = "password = 'secret'   \nother = 1\n"
    assert patch(spark, text, (1, "password = 'secret2'", "password = env()"))[0].startswith("password = env()\n")
    same = patch(spark, text, (1, "entirely different text here", "z"))
    assert same == (text, 0, 1), "a file without a placed fix stays as it is"
    far = "\n" * 30 + "target = 1\n"
    assert patch(spark, far, (5, "target = 1", "target = 2"))[1:] == (0, 1)
    assert patch(spark, far, (21, "target = 1", "target = 2"))[1:] == (1, 0)


def test_whole_function_is_replaced(spark):
    text = "import os\n\ndef f(a):\n    x = 1\n\n    return x\n\n\ndef g():\n    pass\n"
    got, _, _ = patch(spark, text, (3, "def f(a):\n    x = 1", "import sys\n\ndef f(a):\n    return sys.argv"))
    assert got == "import os\nimport sys\n\ndef f(a):\n    return sys.argv\n\n\ndef g():\n    pass\n"
    ast.parse(got)
    assert got.count("def f") == 1


def test_imports(spark):
    text = '#!/usr/bin/env python\n"""Doc."""\nx = 1\n'
    got, _, _ = patch(spark, text, (3, "x = 1", "import b\nimport a\nx = 2"))
    assert got == '#!/usr/bin/env python\n"""Doc."""\nimport a\nimport b\nx = 2\n'
    known, _, _ = patch(spark, "import a\nx = 1\n", (2, "x = 1", "import a\nx = 2"))
    assert known.count("import a") == 1


def test_many_files_and_errors(spark):
    fixes = spark.createDataFrame(
        [(1, "a", 1, "x = 1", "x = 2"), (2, "gone", 1, "q", "r"), (3, "gone", 2, "q", "r"), (4, "a", 1, "", "x"), (5, None, 1, "a", "b"), (6, "a", None, "y = 1", "y = 2")], FIX
    )
    out = pt.patch_files(files(spark, a="x = 1\ny = 1\n", untouched="z"), fixes).collect()
    assert [(r.path, r.content) for r in out if r.kind == "file"] == [("a", "x = 2\ny = 2\n")]
    assert [(r.path, r.error) for r in out if r.kind == "missing"] == [("gone", "File not found")]
    assert pt.patch_files(files(spark, a="x"), fixes.limit(0)).count() == 0


def test_hot_file_streams(spark):
    """One file with many more fixes than an Arrow batch holds."""
    n = 300
    text = "".join(f"value_{i} = {i}\n" for i in range(n))
    fixes = [(i, "hot", i + 1, f"value_{i} = {i}", f"value_{i} = -{i}") for i in range(n)] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = pt.patch_files(files(spark, hot=text), spark.createDataFrame(fixes, FIX)).where("kind = 'file'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows[0].content == text.replace(" = ", " = -")
    assert rows[0].n_applied + rows[0].n_failed == 2 * n


def random_case(seed):
    rng = random.Random(seed)
    words = ["x = 1", "y = call(a)", "return x", "", "  # note", "if a:  # why"]
    lines = [rng.choice(words) + rng.choice(["", "", " ", "!"]) for _ in range(150)]
    fixes = []
    for i in range(60):
        start, n = rng.randrange(150), rng.choice([1, 1, 2, 3, 70])
        snippet = "\n".join(lines[start:start + n])
        if rng.random() < 0.5 and snippet:
            snippet = snippet[:-1] + rng.choice("abc")
        fixes.append((i, "f", max(1, start + 1 + rng.randint(-12, 12)), snippet, "z"))
    return lines, fixes


@pytest.mark.parametrize("seed", [1, 2])
def test_locate_equals_brute_force(spark, seed):
    lines, fixes = random_case(seed)
    source, rows = files(spark, f="\n".join(lines)), spark.createDataFrame(fixes, FIX)
    norm = lambda s: s.replace("  # ", " # ").replace("\n", " ").strip()
    exact, fuzzy = {}, {}
    n_lines = len(lines) - (lines[-1] == "")
    for i, _, line, snippet, _ in fixes:
        n = snippet.count("\n") + 1
        spots = [s for s in range(max(1, line - 10), line + 11) if s + n - 1 <= n_lines]
        texts = {s: "\n".join(lines[s - 1:s - 1 + n]) for s in spots}
        same = [s for s in spots if norm(snippet) and norm(texts[s]) == norm(snippet)]
        if same:
            exact[i] = same[0]
            continue
        scored = [(SequenceMatcher(None, snippet.strip(), texts[s].strip()).ratio(), -s) for s in spots]
        if scored and max(scored)[0] >= 0.85:
            fuzzy[i] = -max(scored)[1]
    assert {r.fix_id: r.start for r in lc.locate_exact(rows, source).collect()} == exact
    assert {r.fix_id: r.start for r in lc.locate_fuzzy(rows, source).collect()} == fuzzy
    assert exact and fuzzy


def test_locate_plan_and_empty(spark):
    source, rows = files(spark, f="a\nb\n"), spark.createDataFrame([(1, "f", 1, "a", "z"), (2, "f", -50, "a", "z"), (3, "g", 1, "a", "z")], FIX)
    found = lc.locate_exact(rows, source)
    assert [(r.fix_id, r.start) for r in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert lc.locate_exact(rows.limit(0), source).count() == 0
    assert lc.locate_fuzzy(rows, files(spark, f="")).count() == 0


def test_similarity(spark):
    pairs = spark.createDataFrame([("abc", "abd"), ("", ""), ("a", ""), (None, "a")], "a string, b string")
    rows = pairs.select(
        sequence_ratio("a", "b").alias("r"), ratio_bound(F.col("a"), F.col("b")).alias("u"), levenshtein_ratio(F.col("a"), F.col("b")).alias("l")
    ).collect()
    assert [r.r for r in rows[:3]] == [pytest.approx(2 / 3), 1.0, 0.0]
    assert rows[3].r is None or rows[3].r != rows[3].r
    assert all(r.u >= r.r for r in rows[:3]) and rows[1].l == 1.0 and rows[2].l == 0.0


def test_grouping(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 20), (3, "a", 10), (4, None, 1), (5, "", 1), (6, "a", None), (7, "b", 1)], "fix_id int, path string, line int")
    got = lc.group_fixes(rows).orderBy("path", "fix_order").collect()
    assert [(r.path, r.line) for r in got] == [("a", 20), ("a", 10), ("a", 5), ("a", None), ("b", 1)]


def test_reindent(spark):
    cases = [("x", 4, "    x"), ("a\n  b", 2, "  a\n    b"), ("    a\n\n      b", 0, "a\n\n  b"), ("", 4, "")]
    rows = spark.createDataFrame(cases, "code string, base int, want string")
    for r in rows.withColumn("got", lc.reindent(F.col("code"), F.col("base"))).collect():
        assert r.got == r.want


def test_block_extent(spark):
    text = "def a():\n    x\n\n    y\n\n\ndef b(): pass\nclass C:\n    def d(self):\n        z\n"
    got = sorted((r.start, r.end) for r in lc.block_extent(files(spark, f=text)).collect())
    assert got == [(1, 4), (7, 7), (8, 10), (9, 10)]


def test_relative_paths(spark):
    rows = spark.createDataFrame([("/r/a/b.py",), ("/other/x.py",)], "path string")
    inside, outside = pt.relative_paths(rows, "/r/")
    assert [r.relative_path for r in inside.collect()] == ["a/b.py"]
    assert [r.path for r in outside.collect()] == ["/other/x.py"]


REM = "fix_id int, type string, file string, line int, severity string, confidence string, snippet string, suggested_fix string, explanation string, cwe_id string, source_documents array<struct<source: string, doc_type: string>>"


def remediations(spark):
    doc = [("s.md", "guide")]
    return spark.createDataFrame(
        [
            (1, "XSS", "/r/a.py", 1, "High", "High", "x = 1", "x = 2", "why", "CWE-79", doc),
            (2, "SQLi", "/r/a.py", 2, "critical", "high", "y = 1", "y = 2", None, None, []),
            (3, "XSS", "/r/b.py", 1, "low", "High", "x", "y", "", "", doc),
            (4, "XSS", "/r/b.py", 1, "high", "Medium", "x", "y", "", "", doc),
            (5, "Path", "/gone.py", 1, "high", "High", "x", "y", "", "", doc),
        ],
        REM,
    )


def test_headline(spark):
    rows = remediations(spark)
    one = ch.change_headline(rows).first()
    assert one.headline == "Fix 5 critical vulnerabilities (Path, SQLi, XSS)"
    more = rows.withColumn("type", F.concat(F.lit("T"), "fix_id"))
    assert ch.change_headline(more).first().headline == "Fix 5 critical vulnerabilities (T1, T2, T3, ...)"
    assert ch.change_headline(rows.limit(0)).first().headline == "Fix security vulnerabilities"
    by_file = {r.file: r.total for r in ch.change_headline(rows, ["file"]).collect()}
    assert by_file == {"/r/a.py": 2, "/r/b.py": 2, "/gone.py": 1}


def test_label(spark):
    when = F.lit("2031-07-15 08:09:10").cast("timestamp")
    rows = remediations(spark)
    assert ch.batch_label(rows, when).first().label == "vulnlake-critical-fixes-20310715-080910"
    assert ch.batch_label(rows.where("fix_id = 1"), when).first().label.startswith("vulnlake-high-severity-")
    assert ch.batch_label(rows.limit(0), when).first().label.startswith("vulnlake-automated-fixes-")


def test_prepare_changes(spark):
    source = files(spark, **{"/r/a.py": "x = 1\ny = 1\n", "/r/b.py": "x\n"})
    change = prepare_changes(remediations(spark), source, "/r")
    assert [(r.relative_path, r.content) for r in change.changed_files.collect()] == [("a.py", "x = 2\ny = 2\n")]
    assert [(r.path, r.error) for r in change.failed_files.collect()] == [("/gone.py", "File not found")]
    assert change.failed_fixes.count() == 0
    assert change.headline.first().total == 3
    report = change.report.orderBy("section", "number", "part").collect()
    text = "\n".join(r.text for r in report)
    assert text.count("| XSS |") == 1 and "### /r/a.py line 2\n\nFix 2 for SQLi" in text
    assert [r.number for r in report if r.section == 5] == [1, 3]
    assert ch.any_rows(ch.change_worthy(remediations(spark).limit(0))).first().worthy is False


def test_ratio_bounds_never_cut_a_result(spark):
    """Both cheap bounds lie above the true ratio, and values of the threshold or more are exact."""
    import random
    from difflib import SequenceMatcher

    from vulnlake.functions import similarity as sm

    rng = random.Random(8)
    texts = ["", "a", "ab", "abc", "é😀x"] + ["".join(rng.choice("abcd é😀") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    pairs = [(x, "".join(c for c in x if rng.random() > p) + "z" * rng.randint(0, 3)) for x in texts for p in (0, 0.05, 0.1, 0.3)]
    pairs += [(rng.choice(texts), rng.choice(texts)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", F.round(sm.levenshtein_ratio(a, b), 6).alias("r"), sm.levenshtein_ratio_above(0.85)(a, b).alias("fast"),
                     sm.levenshtein_bound(a, b).alias("bound"), sm.sequence_ratio_above(0.85)(a, b).alias("matched")).collect()
    for r in rows:
        assert r.r <= r.bound
        assert (r.fast if r.fast is not None and r.fast >= 0.85 else None) == (r.r if r.r >= 0.85 else None), r
        want = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.matched == (want if want >= 0.85 else None)


def test_the_distance_is_worked_out_once_and_only_so_far(spark):
    """The plan holds the distance with its limit, and no file block is gathered per fix."""
    fixes = spark.createDataFrame([(1, "f", 150, "x = 12345678"), (2, "f", 3, "\n".join(["line 9"] * 70))], "fix_id bigint, path string, line int, snippet string")
    body = [f"line {i}" for i in range(1, 401)]
    body[150] = "x = 12345679"
    files = spark.createDataFrame([("f", "\n".join(body))], "path string, content string")
    from vulnlake.functions import similarity as sm

    found = lc.locate_fuzzy(fixes, files, similarity=sm.levenshtein_ratio_above(0.85), bound=sm.levenshtein_bound)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "levenshtein(" in plan
    near = {r.fix_id: (r.start, r.ratio) for r in found.collect()}
    assert near[1] == (151, 0.916667)
