"""Archives: exact round trip, any range size, damaged and misleading bytes."""

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
import pytest
from pyarrow import fs

from vulnlake.llm import warc
from vulnlake.session import shared_dir

PAGES = "page_id long, url string, html string, digest string, first int"


def pages(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" * (i % 50), None, None) for i in range(200)]
    rows += [(300, None, None, None, None), (301, "u", "", None, None), (302, "a\r\nb", "x" * 300_000, None, None), (303, "u", "same", None, None), (303, "u", "same", None, None), (0, "u", "same", None, None), (None, None, "same", None, None)]
    return spark.createDataFrame(rows, PAGES), rows


def expected(rows):
    groups = {}
    for page, _, html, *_ in rows:
        if page is not None:
            groups[html or ""] = max(page, groups.get(html or "", page))
    out = []
    for page, _, html, *_ in rows:
        raw = (html or "").encode()
        first = groups.get(html or "", page)
        revisit = page is not None and first != page
        out.append((-1 if page is None else page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else -1))
    return sorted(out)


def got(frame):
    return sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in frame.collect())


def test_round_trip(spark):
    df, rows = pages(spark)
    assert got(warc.round_trip(spark, df)) == expected(rows)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [500, 4096, 70_001])
def test_any_range_size_reads_each_record_once(spark, size):
    df, rows = pages(spark)
    files = warc.write_archives(warc.classified(df), f"file://{shared_dir(spark).removeprefix('file://')}/warc-{uuid.uuid4().hex}")
    frame = warc.read_archives(files, range_bytes=size, payloads=True)
    assert got(frame) == expected(rows)
    texts = {r.page_id: r.payload for r in frame.collect() if r.record_type == "response" and r.page_id}
    assert all((texts[p] or b"").decode() == (h or "") for p, _, h, *_ in rows if p in texts)


def test_small_payloads_are_all_responses(spark):
    df, _ = pages(spark)
    assert {r.record_type for r in warc.read_archives(warc.write_archives(warc.classified(df.where("page_id < 10"), least=10_000), f"file://{shared_dir(spark).removeprefix('file://')}/w-{uuid.uuid4().hex}")).collect()} == {"response"}


def test_misleading_magic_is_not_a_record(tmp_path):
    real = [warc.record("response", str(i), "u", b"payload" * i, warc.base32_sha1(b"payload" * i), None) for i in range(5)]
    noise = warc.MAGIC + b"noise" + gzip.compress(b"not a record") + warc.MAGIC
    data = real[0] + noise + b"".join(real[1:]) + real[4][:-9]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(path)) as handle:
        for step in (1, 7, 100, 10_000):
            ids = [f["warc-record-id"] for s in range(0, len(data), step) for f, _ in warc.records_in(warc.RangeFile(handle, s, len(data)), s, min(s + step, len(data)))]
            assert ids == [f"<urn:page:{i}>" for i in range(5)]


def test_files_of_lost_attempts_do_not_count(spark):
    df, rows = pages(spark)
    folder = f"file://{shared_dir(spark).removeprefix('file://')}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(warc.classified(df), folder)
    extra, inner = fs.FileSystem.from_uri(folder)
    with extra.open_output_stream(f"{inner}/left-over.warc.gz", compression=None) as out:
        out.write(warc.record("response", "77", "u", b"", warc.base32_sha1(b""), None))
    assert got(warc.read_archives(files)) == expected(rows)
    assert pa.types.is_int64(warc._READ.field("page_id").type)
