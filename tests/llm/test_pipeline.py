"""The pipeline: each stage works on what its predecessor kept, and its decisions take effect."""

import zlib

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts[name] = docs.count()
        if name != "packing":
            assert docs.columns == COLUMNS
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "personal":
            assert counts[name] == before.count()
            assert docs.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]example'").count() == 0
    assert counts["near_duplicates"] < counts["language"] and counts["packing"] >= 1


def test_run_equals_stages(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.count() > 0 and packed.select("sequence_id", "offset").distinct().count() == packed.count()


def test_sequences_can_be_built(spark):
    docs = spark.createDataFrame([(1, "some words " * 1500), (1, "some words"), (1, "some words " * 1500)], "doc_id bigint, text string")
    found = corpus_pipeline.packing_stage(spark, docs, SF_DIR).toPandas()
    assert (found.ids.map(zlib.crc32) == found.ids_crc32).all() and not found.duplicated(["take_id", "start"]).any()
    whole = found.groupby("take_id").agg({"length": "sum", "doc_tokens": "first"})
    assert len(whole) == 3 and (whole.length == whole.doc_tokens).all()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
