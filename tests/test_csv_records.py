"""CSV files cut into many ranges against the csv module."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.sources import csv_records as cr
from vulnlake.sources.corpus import file_name, load_corpus

COLUMNS = {"id": "id", "a": "a", "b": "b"}


def plain(path):
    with open(path, encoding="utf-8", newline="") as f:
        return [tuple(r.get(c) for c in COLUMNS) for r in csv.DictReader(f)]


def got(spark, folder):
    rows, failed = cr.csv_rows(spark, str(folder), "*.[cC][sS][vV]", COLUMNS, file_name(F.col("file")))
    found = {}
    for r in rows.collect():
        found.setdefault(r.source, []).append((r.id, r.a, r.b))
    return {k: sorted(v, key=str) for k, v in found.items()}, {r.path: r.error for r in failed.collect()}


def odd_field(rng):
    return "".join(rng.choice(["x", "yy", '""', ",", "\n", "\r\n", " ", "'", "é", "long " * 9]) for _ in range(rng.randint(0, 8)))


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ranges_equal_the_csv_module(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    for n in range(3):
        out = io.StringIO(newline="")
        writer = csv.writer(out, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(["id", "b", "a"] if n else ["a", "id", "b", "more"])
        for i in range(60):
            writer.writerow([f"{n}.{i}", odd_field(rng), odd_field(rng)][: rng.choice([3, 3, 3, 2])])
        (tmp_path / f"f {n}+1.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    # stray quotes, a blank line, one long quoted field over many ranges, an open quote at the end
    (tmp_path / "g.CSV").write_text('id,a,b\n1,5" pipe,x"y"\n\n2,"q" rest,"a ""b"" c"\n3,"' + "line\n" * 300 + 'end",z\n4,"","open', newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,a,b\n")
    (tmp_path / "other.txt").write_text("id,a,b\n1,2,3\n")
    (tmp_path / "bad.csv").write_bytes(b"id,a,b\n1,\xff\xfe,2\n")
    found, failed = got(spark, tmp_path)
    want = {str(p): sorted(plain(p), key=str) for p in tmp_path.iterdir() if p.suffix.lower() == ".csv" and p.name != "bad.csv"}
    assert found == {k: v for k, v in want.items() if v}
    assert list(failed) == [str(tmp_path / "bad.csv")]
    ranges = spark.read.text(str(tmp_path / "g.CSV")).rdd.getNumPartitions()
    assert ranges > 5


def test_one_record_too_long_fails_its_file_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b\n1,2,3\n" + "4," + "x" * 200_000 + ",5\n")
    (tmp_path / "b.csv").write_text("id,a,b\n1,2,3\n")
    found, failed = got(spark, tmp_path)
    assert found == {str(tmp_path / "b.csv"): [("1", "2", "3")]} and "field larger" in failed[str(tmp_path / "a.csv")]
    none, _ = cr.csv_rows(spark, str(tmp_path / "absent"), "*.csv", COLUMNS, F.col("file"))
    assert none.count() == 0
    docs, bad = load_corpus(spark, str(tmp_path / "absent"))
    assert docs.count() == 0 and bad.count() == 0


def test_states_of_lines_equal_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        out_in, in_in = rng.integers(0, 2, n).astype(bool), rng.integers(0, 2, n).astype(bool)
        for state in (False, True):
            s, want = state, []
            for o, i in zip(out_in, in_in, strict=True):
                s = bool(i if s else o)
                want.append(s)
            assert cr._after(state, out_in, in_in).tolist() == want
