import json
from collections import Counter

import pytest
from packaging.version import Version
from pyspark.sql import functions as F

from vulnlake import domain
from vulnlake.operators import dependencies as dp, findings as fd
from vulnlake.plans.scan import scan
from vulnlake.sources import findings as sf, manifests, sinks
from vulnlake.sources.schemas import SCANNER_OUTPUT

RESULTS = {
    "results": [
        {"test_id": "B105", "issue_text": "secret", "line_number": 10, "issue_severity": "HIGH", "issue_confidence": "MEDIUM",
         "code": "9 \n10 password = 'x'\n11 \n", "filename": "/p/src/a.py"},
        {"test_id": "B602", "issue_text": "shell", "line_number": 3, "issue_severity": "LOW", "issue_confidence": "HIGH",
         "code": "3 run(shell=True)\n", "filename": "/p/src/b.py"},
        {"test_id": "B999", "line_number": 1, "issue_confidence": "HIGH", "code": "", "filename": "/p/tests/t.py"},
        {"test_id": "B301", "line_number": 1, "issue_severity": "WEIRD", "issue_confidence": "HIGH", "filename": "/p/c.py"},
    ]
}


@pytest.fixture()
def results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RESULTS, indent=1))
    (tmp_path / "none.json").write_text('{"results": []}')
    (tmp_path / "other.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{oops")
    return sf.read_scanner_output(spark, str(tmp_path))


def test_read_and_map(results):
    good, bad = results
    assert good.count() == 4
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    mapped, quarantine = fd.map_results(good)
    rows = {r.bandit_test_id: r for r in mapped.collect()}
    assert rows["B105"].type == "Hardcoded Secret" and rows["B105"].snippet == "password = 'x'"
    assert rows["B999"].type == "Unknown Vulnerability" and rows["B999"].severity == "low" and rows["B999"].snippet is None
    assert [r.reason for r in quarantine.collect()] == ["unknown severity: weird"]


def test_rule_table():
    assert len(domain.RULE_CATEGORIES) == 52
    assert len(domain.finding_types()) == 12


def test_levels(spark):
    rows = spark.createDataFrame(
        [(1, "high", "high"), (2, "Medium", "low"), (3, None, None), (4, "critical", "medium"), (5, "odd", "high")],
        "id int, severity string, confidence string",
    )
    assert [r.id for r in fd.min_level(rows).collect()] == [1, 4]
    assert [r.id for r in fd.min_level(rows, "low", "low").collect()] == [1, 2, 3, 4]
    assert [r.id for r in fd.severity_at_least(rows, "low").collect()] == [1, 2, 3, 4, 5]
    assert [r.id for r in fd.severity_at_least(rows, "high").collect()] == [1, 4]


def test_exclude(spark):
    files = ["tests/a.py", "src/tests.py", "a/venv/b.py", "src/x.json", "x.json", "remediation/corpus/a.py", "remediation/b.py", ".env", "a/.env"]
    rows = spark.createDataFrame([(f, "B1") for f in files] + [("ok.py", "B101"), (None, "B1")], "file string, test_id string")
    kept = fd.exclude(rows, ["B101"], ["tests", "venv", "remediation/corpus", "**/*.json", "**/.env"]).collect()
    assert [r.file for r in kept] == ["src/tests.py", "remediation/b.py", None]
    assert fd.exclude(rows).count() == len(files) + 2


def test_common_root(spark):
    rows = spark.createDataFrame(
        [("a", "/r/x/a.py"), ("a", "/r/x/y/b.py"), ("b", "/r/one/f.py"), ("c", "/p/a.py"), ("c", "/q/a.py"), ("d", "f.py")], "k string, file string"
    )
    got = {r.k: r.common_root for r in fd.common_root(rows, by=["k"]).collect()}
    assert got == {"a": "/r/x", "b": "/r/one", "c": "", "d": ""}


def test_normalise_finding(spark):
    code = spark.createDataFrame([("XSS", 3, None, "x"), (None, None, "a.py", None)], "type string, line int, file string, snippet string")
    deps = spark.createDataFrame([("flask", "1.0", ["A", "B"], None), ("six", "2", None, "r.txt")], "package string, version string, cves array<string>, file string")
    rows = fd.normalise_finding(fd.union_findings(code, deps)).collect()
    got = [(r.finding_type, r.file_path, r.line_number, r.code, r.level, r.cwe) for r in rows]
    assert got == [
        ("XSS", "Unknown", "3", "x", "High", ""),
        ("Unknown", "a.py", "Unknown", "", "High", ""),
        ("Vulnerable Dependency: flask", "requirements.txt", "N/A", "flask==1.0\nCVEs: A, B", "High", ""),
        ("Vulnerable Dependency: six", "r.txt", "N/A", "six==2\nCVEs: ", "High", ""),
    ]


def test_manifests(spark, tmp_path):
    (tmp_path / "requirements.txt").write_bytes("﻿flask==1.0\n# note\nsix>=1\nbad==1==2\r\n  django == 3.0 \n".encode())
    (tmp_path / "wide.txt").write_bytes("jinja2==2.0\n".encode("utf-16"))
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["requests>=2.0,<3", "bare", "click==8.0"]\n')
    (tmp_path / "empty.toml").write_text('[tool]\nx = 1\n')
    (tmp_path / "bad.toml").write_text("[project")
    good, bad = manifests.read_manifests(spark, str(tmp_path))
    assert sorted((r.package, r.version) for r in good.collect()) == [
        ("click", "8.0"), ("django", "3.0"), ("flask", "1.0"), ("jinja2", "2.0"), ("requests", "2.0")
    ]
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["bad.toml", "requirements.txt"]


def test_match_advisories_equals_brute_force(spark):
    versions = "0.1 1.0a1 1.0 1.0.1 1.2 1.10 2.0rc1 2.0 2.0.post1 3.5 junk".split()
    deps = [("f", p, v) for p in ("Pkg_One", "two", "three") for v in versions]
    ranges = [
        ("A1", "PyPI", "pkg-one", "0", "1.0", None), ("A2", "PyPI", "pkg.one", "1.0", None, None), ("A3", "PyPI", "two", None, None, "1.2"),
        ("A3", "PyPI", "two", "2.0", "2.0.post1", None), ("A4", "npm", "two", "0", None, None), ("A5", "PyPI", "two", "??", None, None),
    ]
    schema = "vuln_id string, ecosystem string, package string, introduced string, fixed string, last_affected string"
    rows = dp.match_advisories(
        spark.createDataFrame(deps, "file string, package string, version string"), spark.createDataFrame(ranges, schema)
    ).collect()
    fold = lambda n: n.lower().replace("_", "-").replace(".", "-")
    want = {}
    for _, p, ver in deps:
        if ver == "junk":
            continue
        x = Version(ver)
        hits = {
            i for i, eco, q, lo, hi, last in ranges
            if eco == "PyPI" and fold(q) == fold(p) and lo != "??" and (lo in (None, "0") or x >= Version(lo))
            and (hi is None or x < Version(hi)) and (last is None or x <= Version(last))
        }
        if hits:
            want[(p, ver)] = sorted(hits)
    assert {(r.package, r.version): r.cves for r in rows} == want
    assert dp.range_keys(spark.createDataFrame(ranges, schema))[1].count() == 1
    assert dp.unreadable_versions(spark.createDataFrame(deps, "file string, package string, version string")).count() == 3


def test_match_plan_has_no_product(spark):
    deps = spark.range(100).select(F.concat(F.lit("p"), F.col("id") % 7).alias("package"), F.lit("1.0").alias("version"))
    ranges = spark.range(100).select(
        F.col("id").cast("string").alias("vuln_id"), F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("p"), F.col("id") % 7).alias("package"),
        F.lit("0").alias("introduced"), F.lit("2.0").alias("fixed"), F.lit(None).cast("string").alias("last_affected"),
    )
    plan = dp.match_advisories(deps, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_and_report(spark, results, tmp_path):
    good, _ = results
    deps = spark.createDataFrame([("r.txt", "flask", "1.0"), ("r.txt", "six", "9")], "file string, package string, version string")
    ranges = spark.createDataFrame(
        [("V1", "PyPI", "Flask", "0", "2.0", None)], "vuln_id string, ecosystem string, package string, introduced string, fixed string, last_affected string"
    )
    done = scan(good, deps, ranges, exclude_paths=["tests"])
    assert done.summary.first().asDict() == {
        "total_findings": 1, "total_cve_findings": 1, "low": 0, "medium": 0, "high": 1, "critical": 0
    }
    assert done.root.first().common_root == "/p/src" and done.quarantine.count() == 1
    path = str(tmp_path / "out")
    sinks.write_report(done.findings, done.dependencies, path, root="/p")
    back = sf.read_report_tables(spark, path)
    assert sorted(r.origin for r in back.collect()) == ["cve", "sast"]
    text = spark.read.text(path + "/sast_findings").first().value
    assert "cwe_id" not in text and '"bandit_test_id":"B105"' in text
    summary = json.loads(spark.read.text(path + "/summary").first().value)
    assert summary["by_severity"] == {"low": 0, "medium": 0, "high": 1, "critical": 0} and summary["repository_root"] == "/p"
    assert scan(good).summary.first().total_cve_findings == 0


def test_read_nested_report(spark, tmp_path):
    report = {
        "summary": {"total_findings": 3}, "repository_root": "/r",
        "sast_findings": [{"type": "XSS", "severity": s, "line": 1, "file": "a.py"} for s in ("high", "medium", "low")],
        "cve_findings": [{"package": "p", "version": "1", "cves": ["C"], "file": "r.txt"}],
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "partial.json").write_text('{"sast_findings": []}')
    (tmp_path / "bad.json").write_text("nope{")
    rows, bad = sf.read_report(spark, str(tmp_path))
    assert bad.count() == 1 and rows.count() == 4
    assert fd.select_origin(rows, sast_only=True, cve_only=True).count() == 3
    assert fd.select_origin(rows, cve_only=True).first().cves == ["C"]
    assert fd.severity_at_least(rows, "high").count() == 1
    assert fd.severity_at_least(rows, "medium").count() == 2


def test_rule_scan(spark):
    docs = spark.createDataFrame([("a", 'x\n  token = "abc"\nurl http://h token = "q"'), ("b", None), ("c", "")], "path string, content string")
    rules = [fd.PatternRule("B105", r"token\s*=", "high", "high"), fd.PatternRule("B113", "http://", "low", "low")]
    got = [(r.path, r.line, r.test_id, r.type, r.snippet) for r in fd.rule_scan(docs, rules).collect()]
    assert got == [
        ("a", 2, "B105", "Hardcoded Secret", 'token = "abc"'),
        ("a", 3, "B105", "Hardcoded Secret", 'url http://h token = "q"'),
        ("a", 3, "B113", "Insecure Configuration", 'url http://h token = "q"'),
    ]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCANNER_OUTPUT).select(F.explode("results").alias("r")).select("r.*")
    done = scan(none)
    assert done.findings.count() == 0 and done.root.count() == 1
    assert done.summary.first().total_findings == 0


def test_source_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x\ny\n")
    (tmp_path / "b.py").write_text("z")
    wanted = spark.createDataFrame([(str(tmp_path / "a.py"),), (str(tmp_path / "gone.py"),)], "path string")
    files, failed = sf.read_source_files(spark, str(tmp_path), wanted)
    assert [(r.line_no, r.text) for r in sf.code_lines(files).collect()] == [(1, "x"), (2, "y")]
    assert [r.error for r in failed.collect()] == ["File not found"]
    assert sf.read_source_files(spark, str(tmp_path))[0].count() == 2
    (tmp_path / "latin.py").write_bytes("x = 'é'".encode("latin-1"))
    (tmp_path / "crlf.py").write_bytes(b"one\r\ntwo\r\n")
    files, failed = sf.read_source_files(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in failed.collect()] == [("latin.py", "not UTF-8")]
    assert files.where("path like '%crlf.py'").first().content == "one\ntwo\n"


def test_ranges_over_many_versions_equal_brute_force(spark, monkeypatch):
    """Many versions (equal ones written in several ways) and ranges of one package, cut into short stretches."""
    import random

    from vulnlake.operators import dependencies as dp

    monkeypatch.setattr(dp, "STRETCH", 3)
    rng = random.Random(4)
    version = lambda: (rng.randint(0, 4), rng.randint(0, 3))
    written = lambda v: rng.choice([f"{v[0]}.{v[1]}", f"{v[0]}.{v[1]}.0", f"v{v[0]}.{v[1]}"])
    pins = [(i, rng.choice(["Hot_Pkg", "hot.pkg", "hot-pkg", "other"]), version()) for i in range(150)]
    ranges = [(f"V{i}", rng.choice(["hot-pkg", "other", "third"]), *(rng.choice([None, version()]) for _ in range(3))) for i in range(80)]
    deps = spark.createDataFrame([(i, p, written(v)) for i, p, v in pins] + [(900, "hot-pkg", "nonsense"), (901, None, "1.0"), (902, "hot-pkg", None)], "dep_id int, package string, version string")
    text = lambda v: None if v is None else written(v)
    rows = [(i, "PyPI", p, text(lo), text(hi), text(last)) for i, p, lo, hi, last in ranges] + [("VX", "npm", "other", None, None, None)]
    table = spark.createDataFrame(rows, "vuln_id string, ecosystem string, package string, introduced string, fixed string, last_affected string")
    got = {r.dep_id: r.cves for r in dp.match_advisories(deps, table).collect()}
    want = {}
    for i, p, v in pins:
        name = "other" if p == "other" else "hot-pkg"
        ids = sorted(k for k, q, lo, hi, last in ranges if q == name and (lo is None or v >= lo) and (hi is None or v < hi) and (last is None or v <= last))
        if ids:
            want[i] = ids
    assert got == want and len(want) > 100


def test_versions_are_read_once(spark):
    """the groups of a version are cut out by one regex each time its key is wanted."""
    from vulnlake.functions.versions import version_key

    rows = spark.createDataFrame([("1.10.0rc2",), ("x",), (None,)], "v string").select(version_key(F.col("v")).alias("k"))
    assert [r.k for r in rows.collect()] == [[0, 1, 10, -1, 3, 2, 0, 2**63 - 1], None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_report_query_moves_pins_not_lists(spark, tmp_path, monkeypatch):
    """advisories are matched per report and pin; lists are repeated only in the files."""
    import pandas as pd

    from checks import storage

    e = [(i, "a", "view", float(i), "{}") for i in range(1200)]
    pd.DataFrame([(i, i % 7, k, v, p) for i, _, k, v, p in e], columns=["event_id", "user_id", "event_type", "value", "props"]).to_parquet(tmp_path / "events.parquet")
    pd.DataFrame({"p_partkey": [200 * i + 1 for i in range(1100)], "p_size": 0}).astype("int64").to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"s_suppkey": [200 * i + 1 for i in range(300)]}).to_parquet(tmp_path / "supplier.parquet")
    matched = []

    def match(deps, ranges):
        out = dp.match_advisories(deps, ranges)
        matched.append(out)
        return out

    monkeypatch.setattr(storage, "match_advisories", match, raising=False)
    got = storage.read_report(spark, str(tmp_path))
    want = storage.write_report(spark, str(tmp_path))
    count = lambda rows: Counter(tuple(r) for r in rows.collect())
    assert count(got) == count(want) and sum(count(got).values()) > 1200
    assert matched and matched[0].count() < 30 < got.where("origin = 'cve'").count()
