from packaging.version import Version
from pyspark.sql import functions as F

from vulnlake.functions import paths, text, vectors, versions
from vulnlake.operators.dependencies import parse_specs


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(spark, fn, values, kind="string"):
    rows = column(spark, values, kind).select(fn(F.col("x")).alias("y")).collect()
    return [r.y for r in rows]


def test_clean_snippet(spark):
    got = apply(spark, text.clean_snippet, ["45  a = 1\n46\n47\tb\n", "  x  ", "", None, "1\n2\n"])
    assert got == ["a = 1\n\nb", "x", None, None, ""]


def test_unescape_and_tokens(spark):
    assert apply(spark, text.unescape_newlines, ["a\\nb", "a\nb"]) == ["a\nb", "a\nb"]
    assert apply(spark, text.tokens, ["  Foo\u00a0bar\tFOO ", "", None]) == [["foo", "bar", "foo"], [], None]


def test_titles_and_suffix(spark):
    assert apply(spark, text.guide_title, ["/a/Cross_site-scripting_x.md", "b.MD", "c.d.md", "/a/.md"]) == [
        "Cross Site-Scripting X", "B", "C.D", ".Md",
    ]
    assert apply(spark, text.suffix_of, ["/a/b.YML", "/a.b/c", "x.tar.md"]) == [".yml", "", ".md"]


def test_aliases(spark):
    assert apply(spark, text.cve_aliases, [["GHSA-1", "CVE-1", "CVE-2"], []], "array<string>") == ["CVE-1, CVE-2", ""]


def test_decode_text(spark):
    words = "naïve café"
    blobs = [words.encode("utf-8"), words.encode("utf-8-sig"), words.encode("utf-16"), words.encode("latin-1") + b"!", None]
    got = [r.y for r in column(spark, blobs, "binary").select(text.decode_text("x").alias("y")).collect()]
    assert got[:3] == [words] * 3
    assert got[3] is not None and got[4] is None


def test_requirement_specs(spark):
    cases = {
        "requests==2.32.0": ("requests", "2.32.0"),
        "requests>=2.32.0": ("requests", "2.32.0"),
        "click>=8.3.0,<9.0.0": ("click", "8.3.0"),
        "flask": (None, None),
        "uvicorn[standard]>=0.30": ("uvicorn", "0.30"),
        "invalid>>spec": (None, None),
        "six==1.0 ; python_version < '3'": ("six", "1.0"),
        "old<2": ("old", "2"),
        "both>=1.0,==1.5,<2": ("both", "1.5"),
        "compat~=1.4": ("compat", None),
        "par (>=1.0, <2)": ("par", "1.0"),
        "": (None, None),
        "@@@": (None, None),
    }
    rows = parse_specs(column(spark, list(cases)), "x").collect()
    assert {r.x: (r.package, r.version) for r in rows} == cases


def test_version_order_matches_packaging(spark):
    names = (
        "0 0.9 1.0.dev1 1.0a1.dev2 1.0a1 1.0a2 1.0b1 1.0rc1 1.0c2 1.0 1.0.post1.dev3 1.0.post1 1.0-2 1.0.1 1.1 1.10 1.10.0.1 1.2.3.4.5.6.7.8.9 1.2.3.4.5.6.7.8.10 20230101120000 1.0.dev202301011200 1.0.post20230101120000 2!0.1 v3.0"
    ).split()
    keys = dict(zip(names, apply(spark, versions.version_key, names)))
    known = [n for n in names if n != "v3.0"]
    assert sorted(known, key=lambda n: keys[n]) == sorted(known, key=Version)
    for a in known:
        for b in known:
            assert (keys[a] < keys[b]) == (Version(a) < Version(b)), (a, b)
    assert apply(spark, versions.version_key, ["1.0"]) == apply(spark, versions.version_key, ["1.0.0+local"])
    assert apply(spark, versions.version_key, ["abc", "", None, "1." + "9" * 30, "1..2"]) == [None] * 5
    assert apply(spark, versions.version_key, [f"1.0.dev{9 * 10**30}", f"1.0.post{9 * 10**30}", f"{9 * 10**30}!1"]) == [None] * 3


def test_paths(spark):
    rows = spark.createDataFrame(
        [("/a/b/c.py", "/a/b"), ("/a/bc/d.py", "/a/b"), ("C:\\r\\x\\y.py", "C:\\r\\"), ("/a/b", "/a/b")], "p string, r string"
    )
    got = [r.y for r in rows.select(paths.relative_to(F.col("p"), F.col("r")).alias("y")).collect()]
    assert got == ["c.py", None, "x/y.py", "."]


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])],
        "a array<double>, b array<double>",
    )
    got = [r.c for r in rows.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 9).alias("c")).collect()]
    assert got == [1.0, 0.0, -1.0, None, None]


def test_embedding(spark):
    got = apply(spark, vectors.embed_hashed, ["a b a", "", None])
    assert [sum(v) for v in got] == [3.0, 0.0, 0.0]
    assert all(len(v) == vectors.EMBED_DIM for v in got)


def test_words_are_hashed_once_a_batch(spark, monkeypatch):
    """an embedding counts the buckets of its words, and a word of many rows is not hashed for each of them."""
    import hashlib

    from vulnlake.functions.vectors import embed_hashed

    texts = ["one Two two", "", None, " \n", "two é one", "1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = rows.select("i", embed_hashed(F.col("t")).alias("v"))
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        want = [0.0] * 64
        for w in (texts[r.i] or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert r.v == want
