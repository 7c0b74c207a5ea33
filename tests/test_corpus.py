import random

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import corpus as cp
from vulnlake.plans.ingest import ingest
from vulnlake.sources import corpus as src, index


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")


def test_sections_keep_every_line(spark):
    text = "intro\n# A\nx\n## B\n```\n# not a heading\n```\n# C\n### D\nend\n"
    rows = cp.sections(spark.createDataFrame([("g", text)], "source string, text string")).orderBy("seq").collect()
    assert [(r.h1, r.h2, r.h3) for r in rows] == [
        (None, None, None), ("A", None, None), ("A", "B", None), ("C", None, None), ("C", None, "D")
    ]
    assert "\n".join(r.content for r in rows) == text
    assert cp.sections(spark.createDataFrame([("g", None), ("h", " \n")], "source string, text string")).count() == 0


def random_text(rng):
    """Words of letters that never repeat, so that a piece has one place only."""
    letters = (chr(c) for c in range(0x4E00, 0x9F00))
    words = ["".join(next(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 120))]
    return "".join(w + rng.choice([" ", " ", "\n", "\n\n"]) for w in words)


@pytest.mark.parametrize("size,overlap", [(40, 10), (100, 0), (25, 24)])
def test_splitter_invariants(spark, size, overlap):
    rng = random.Random(size)
    texts = [random_text(rng) for _ in range(40)] + ["", "".join(chr(0x4E00 + i) for i in range(333))]
    rows = cp.chunk_recursive(docs(spark, *texts), size, overlap).orderBy("id", "seq").collect()
    for i, text in enumerate(texts):
        pieces = [r.content for r in rows if r.id == i]
        assert all(0 < len(p) <= size for p in pieces)
        at = -1
        covered = set()
        for piece in pieces:
            at = text.find(piece, max(at, 0))
            assert at >= 0, "pieces occur in order"
            covered.update(range(at, at + len(piece)))
        assert all(k in covered for k, c in enumerate(text) if not c.isspace()), "no character lost"


def plain_pieces(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    sep, finer = next((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text)
    first, *rest = list(text) if sep == "" else text.split(sep)
    parts = [p for p in [first, *((sep if sep else "") + r for r in rest)] if p]
    out, window = [], []

    def give():
        if "".join(window).strip():
            out.append("".join(window).strip())

    for part in parts:
        if len(part) >= size and finer:
            give()
            window = []
            out += plain_pieces(part, size, overlap, finer)
            continue
        if sum(map(len, window)) + len(part) > size:
            give()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window = window[1:]
        window = [*window, part]
    give()
    return out


@pytest.mark.parametrize("size,overlap", [(40, 10), (100, 0), (25, 24), (7, 3)])
def test_splitter_equals_a_plain_version(spark, size, overlap):
    rng = random.Random(size + 1)
    texts = [random_text(rng)[:1500] for _ in range(30)] + ["a" * size, "a" * (size + 1), " " * 90, "\n\n x \n\n" * 30, "b" * 333, "ab cd " * 200, "x" * 50 + " y\n" + "z" * 60]
    got = {}
    for r in cp.chunk_recursive(docs(spark, *texts), size, overlap).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.content)
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain_pieces(text, size, overlap), repr(text[:60])


def test_long_documents_take_linear_time(spark):
    """Headings, sections and blocks of many lines in one row."""
    import time

    text = "\n".join(f"# h{i}" if i % 50 == 0 else f"def f{i}():" if i % 7 == 0 else f"    line {i}" for i in range(60_000))
    df = spark.createDataFrame([("g", text)], "source string, text string")
    began = time.time()
    assert cp.sections(df).count() == 1200 and cp.header_path(df).where("h1 = 'h59950'").count() == 50
    from vulnlake.operators.locating import block_extent

    assert block_extent(df, "source", "text").count() == sum(i % 7 == 0 and i % 50 > 0 for i in range(60_000))
    assert time.time() - began < 120


def test_splitter_leaves_short_text(spark):
    rows = cp.chunk_recursive(docs(spark, "short text", None)).collect()
    assert [(r.id, r.seq, r.content) for r in rows] == [(0, 1, "short text")]
    with pytest.raises(ValueError):
        cp.chunk_recursive(docs(spark, "a"), 10, 10)


def test_window_chunks(spark):
    rows = cp.chunk_window(docs(spark, "abcdefghij", "", None, "abc"), 4, 1).orderBy("id", "seq").collect()
    assert [(r.id, r.content) for r in rows] == [(0, "abcd"), (0, "defg"), (0, "ghij"), (3, "abc")]


def write(path, name, data):
    target = path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture()
def corpus_dir(tmp_path):
    write(tmp_path, "cwe/a.csv", 'CWE-ID,Name,Description,Extended Description,Potential Mitigations\n79,XSS,"bad, ""quoted""\nlines",,Escape\n')
    write(tmp_path, "cwe/b.CSV", "CWE-ID,Name\n89,SQLi\n")
    write(tmp_path, "cwe/bad.csv", b"CWE-ID,Name\n1,\xff\xfe\n")
    write(tmp_path, "md/Cross_site_guide.md", "# T\nsmall\n## Long\n" + "word " * 400)
    write(tmp_path, "md/bad.md", b"\xff\xfe\xff")
    write(
        tmp_path, "adv/x.yaml",
        "id: PYSEC-1\ndetails: d\naliases: [CVE-1, GHSA-2]\naffected:\n- package: {name: django, ecosystem: PyPI}\n  ranges:\n"
        "  - type: ECOSYSTEM\n    events:\n    - introduced: '0'\n    - fixed: '1.2'\n    - introduced: '2.0'\n"
        "  - type: GIT\n    events:\n    - introduced: '0'\n    - fixed: abcdef\nreferences:\n- {type: WEB, url: u}\n- {url: v}\n",
    )
    write(tmp_path, "adv/min.yml", "id: PYSEC-2\n")
    write(tmp_path, "adv/bad.yaml", "id: [open")
    write(tmp_path, "skip/readme.txt", "ignored")
    return str(tmp_path)


def test_load_corpus(spark, corpus_dir):
    documents, failed = src.load_corpus(spark, corpus_dir)
    rows = documents.collect()
    by_type = {t: [r for r in rows if r.doc_type == t] for t in {r.doc_type for r in rows}}
    weak = {r.cwe_id: r for r in by_type["cwe"]}
    assert weak["CWE-79"].content == 'CWE-79: XSS\n\nDescription: bad, "quoted"\nlines\n\nMitigations:\nEscape'
    assert weak["CWE-89"].content == "CWE-89: SQLi\n\nDescription: \n\n"
    advisory = next(r for r in by_type["pypa_advisory"] if r.vulnerability_id == "PYSEC-1")
    assert advisory.aliases == "CVE-1, GHSA-2" and advisory.cve_ids == "CVE-1"
    assert "  - django (PyPI)\n    - introduced: 0\n    - fixed: 1.2\n" in advisory.content
    assert advisory.content.endswith("References:\n  - [WEB] u\n  - [LINK] v\n")
    guides = by_type["owasp_cheatsheet"]
    assert all(r.pre_chunked and len(r.content) <= 800 and r.title == "Cross Site Guide" for r in guides)
    assert {r.h2 for r in guides} == {None, "Long"} and len(guides) >= 4
    assert sorted(r.path.rsplit("/", 1)[1] for r in failed.collect()) == ["bad.csv", "bad.md", "bad.yaml"]


def test_missing_and_empty_folder(spark, tmp_path):
    for path in (str(tmp_path), str(tmp_path / "nothing")):
        documents, failed = src.load_corpus(spark, path)
        assert documents.count() == 0 and failed.count() == 0


def test_ranges_leave_out_commits(spark, corpus_dir):
    files = src.corpus_scan(spark, corpus_dir).where(F.col("ext").isin(".yaml", ".yml"))
    _, ranges, failed = src.read_advisories(files)
    got = sorted((r.introduced, r.fixed) for r in ranges.where("vuln_id = 'PYSEC-1'").collect())
    assert got == [("0", "1.2"), ("2.0", None)]
    assert failed.count() == 1


def test_read_guides_and_weaknesses(spark, corpus_dir):
    guides = src.read_guides(spark, corpus_dir + "/md").where(F.is_valid_utf8("text")).collect()
    assert "Cross Site Guide" in [g.title for g in guides]
    assert src.read_weaknesses(spark, corpus_dir + "/cwe/a.csv").first().cwe_id == "CWE-79"


def test_ingest_and_index(spark, corpus_dir, tmp_path):
    documents, _ = src.load_corpus(spark, corpus_dir)
    chunks = ingest(documents)
    rows = chunks.collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert all(len(r.content) <= 800 for r in rows)
    fresh_only = ingest(documents, index_prechunked=False)
    assert fresh_only.where("doc_type = 'owasp_cheatsheet'").count() == 0
    path = str(tmp_path / "index")
    assert index.load_index(spark, path) == (None, None)
    index.write_index(chunks, path)
    with pytest.raises(FileExistsError, match="ALREADY_EXISTS"):
        index.write_index(chunks, path)
    index.write_index(chunks, path, rebuild=True)
    stored, bm25 = index.load_index(spark, path)
    assert stored.count() == len(rows) and bm25.terms.count() > 0
    total = cp.index_stats(stored).where("level = 3").first()
    assert total.chunks == len(rows)
