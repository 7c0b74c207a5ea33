"""The pipeline on the smallest tables: stage by stage against the operators' own results."""

import corpus_pipeline
from helpers import DOCS, odd_rows
from vulnlake.llm import minhash, secret_scan, stages

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = docs
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF_DIR)
        if name != "packing":
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if name == "near_duplicates":
            kept = {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        elif name == "secrets":
            assert docs.count() == before.count()
            assert all(not secret_scan.base_spans(r.text) for r in docs.collect())
        elif name in ("quality", "language"):
            assert 0.7 * before.count() < docs.count() <= before.count()
    assert docs.select("doc_id").distinct().count() == before.count()
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r.ids_crc32 for r in again.collect()) == sorted(r.ids_crc32 for r in docs.collect())


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert stages.good_documents(docs, none).count() == len(odd_rows())
    assert stages.known_language(docs).columns == docs.columns
    left = stages.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [9001, 9002, 9003, 9004, 9006, 9007]
    assert left.where("doc_id is null").count() == 2
    empty = docs.limit(0)
    for out in (stages.good_documents(empty, none), stages.known_language(empty), stages.one_of_each(empty), stages.without_secrets(empty)):
        assert out.count() == 0
