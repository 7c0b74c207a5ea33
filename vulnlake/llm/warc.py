"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges to tasks: a task looks
for the gzip magic in its range, proves a candidate by decompressing it to a WARC header, to
its declared block length and to the member's checksum, and owns the records that start
inside its range (it reads on beyond the end of the range to finish the last one). After a
record the next member is expected right behind it; elsewhere the search goes on.

Files are reached through Arrow's file systems, so the folder must be one that they and Spark
both know (a mounted path, S3, GCS, HDFS). Writing survives lost executors: each attempt of a
task writes a file of its own name, and only files that a finished attempt reported count.

Defined cases: a null payload is an empty one. Of the pages with equal payloads of at least
``least`` bytes the one with the largest page_id is the response (all rows with that id, if
it repeats), the others revisit it; smaller payloads, and pages without an id, are responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import shared_dir, stage

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
RANGE = 4 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit keeps the payload's size in its HTTP header, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c for c in url or "about:blank" if c not in "\r\n")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, and refers_to (null for a response).

    Pages meet their group's largest id by payload digest: one row a digest, aggregated before
    the shuffle; of a hot digest only the page side is large, and skewed joins are split.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    large = (F.octet_length(F.coalesce("html", F.lit(""))) >= least) & F.col("page_id").isNotNull()
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(large & (F.col("first") != F.col("page_id")), F.col("first"))
    return rows.join(groups.select("digest", "first"), "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


_FILES = pa.schema([("path", pa.string()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task below ``folder``; returns (path, bytes) of the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page, url, html, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                kind = "response" if refers is None else "revisit"
                data = record(kind, "" if page is None else str(page), url, payload, base32_sha1(payload), None if refers is None else str(refers))
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size]}, schema=_FILES)

    return stage(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long"), "archives")


class RangeFile:
    """Bytes of a file from a start on, read piece by piece as they are asked for."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.start, self.size = handle, start, size
        self.data = bytearray()

    def upto(self, end: int) -> bytearray:
        """The bytes read so far, at least up to file position ``end`` (or the end of file)."""
        need = min(end, self.size) - self.start - len(self.data)
        if need > 0:
            self.handle.seek(self.start + len(self.data))
            self.data += self.handle.read(max(need, CHUNK))
        return self.data

    def drop(self, before: int) -> None:
        """Forgets what lies before a file position."""
        gone = min(before - self.start, len(self.data))
        if gone > 0:
            del self.data[:gone]
            self.start += gone


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def member(file: RangeFile, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(header fields, block, end position) of the WARC record that starts at ``at``, or None.

    A candidate is dropped as soon as its first bytes are not a WARC header, before the rest
    of it is read; a whole one must pass the gzip checksum and hold its declared length.
    """
    unpack = zlib.decompressobj(31)
    out, position = bytearray(), at
    try:
        while not unpack.eof:
            data = file.upto(position + CHUNK)
            piece = bytes(data[position - file.start : position - file.start + CHUNK])
            if not piece:
                return None
            out += unpack.decompress(piece)
            position += len(piece)
            if not out.startswith(VERSION[: len(out)]) and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    head, found, block = bytes(out).partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not length.isdigit() or block[int(length) :] != b"\r\n\r\n":
        return None
    return fields, block[: int(length)], position - len(unpack.unused_data)


def records_in(file: RangeFile, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in [start, end)."""
    at = start
    while at < end:
        data = file.upto(min(at + CHUNK, end + len(MAGIC) - 1))
        hit = data.find(MAGIC, at - file.start, end + len(MAGIC) - 1 - file.start)
        if hit < 0:
            at = max(at + 1, file.start + len(data) - len(MAGIC) + 1)
            if file.start + len(data) >= min(end + len(MAGIC) - 1, file.size):
                return
            file.drop(at)
            continue
        at = hit + file.start
        found = member(file, at)
        if found is None:
            at += 1
            continue
        yield found[0], found[1]
        at = found[2]
        file.drop(at)


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _page(value: str) -> int | None:
    body = value.strip("<>").removeprefix("urn:page:")
    return int(body) if body else None


def read_archives(files: DataFrame, range_bytes: int = RANGE, payloads: bool = False) -> DataFrame:
    """Records of the files (path, bytes): one row each, with the payload where asked for.

    Sizes and digests of responses are those of the payload read; a revisit has the digest of
    its header and the size that its HTTP header keeps. A response whose payload differs from
    its digest fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "end", "bytes")), strict=True):
                system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                rows: list[tuple] = []
                held = 0
                with system.open_input_file(inner) as handle:
                    for fields, block in records_in(RangeFile(handle, start, size), start, end):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        length = int(_fields(head)["content-length"])
                        if not revisit and (base32_sha1(payload) != digest or len(payload) != length):
                            raise ValueError(f"damaged record {fields.get('warc-record-id')} in {path}")
                        refers = _page(fields["warc-refers-to"]) if revisit else None
                        kept = payload if payloads and not revisit else None
                        rows.append((_page(fields["warc-record-id"]), length, digest, fields["warc-type"], refers, fields["warc-target-uri"], kept))
                        held += len(kept or b"") + 200
                        if held > CHUNK * 64:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", start.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    tasks = max(1, int(files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return ranges.repartition(min(tasks, 10_000)).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    base = shared_dir(spark)
    folder = f"{base if '://' in base else 'file://' + base if base.startswith('/') else base.replace('file:', 'file://', 1)}/vulnlake/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(classified(pages, least), folder)).drop("url", "payload")
