import json
import os

import pytest
from pyspark.sql import functions as F

from bitextry.operators.scoring import Bleu, Chrf, Ter
from bitextry.plans import jobs
from bitextry.sources import corpora, reports, text
from bitextry.streaming.step_metrics import step_scores, watch_steps


def lines_of(df, column="text"):
    rows = sorted((r["line_no"], r[column]) for r in df.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [t for _, t in rows]


def put(path, lines):
    path.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("block_bytes", ["64", "134217728"])
@pytest.mark.parametrize("freeze", [False, True])
def test_lines_are_numbered_in_list_order(spark, tmp_path, block_bytes, freeze):
    small = put(tmp_path / "b first é.txt", [f"small {i}" for i in range(5)])
    large = put(tmp_path / "a second.txt", [f"large {i}" * (1 + i % 4) if i % 9 else "" for i in range(600)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    try:
        for order in ((small, large), (large, small)):
            want = [line for path in order for line in open(path, encoding="utf-8").read().split("\n")[:-1]]
            got = text.scan_groups(spark, {"g": list(order)}, freeze=freeze)
            assert lines_of(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_as_python_reads_them(spark, tmp_path):
    path = tmp_path / "odd.txt"
    path.write_bytes("a\r\nb\rc d\n\nlast".encode())
    assert lines_of(text.read_lines(spark, str(path))) == open(path, encoding="utf-8").read().split("\n")


def test_a_file_listed_twice_counts_twice(spark, tmp_path):
    path = put(tmp_path / "x.txt", ["a", "b"])
    assert lines_of(text.read_lines(spark, [path, path])) == ["a", "b", "a", "b"]


@pytest.mark.parametrize("gap", [1, 1000])
def test_sink_keeps_order(spark, tmp_path, gap):
    rows = spark.range(5000).select((F.col("id") * gap).alias("line_no"), F.concat(F.lit("row "), "id").alias("x")).repartition(11)
    out = str(tmp_path / "out")
    text.write_lines(rows, "x", out, lines_per_file=700)
    assert lines_of(text.read_lines(spark, out)) == [f"row {i}" for i in range(5000)]
    assert sum(f.endswith(".txt") for f in os.listdir(out)) >= 7


def test_sink_refuses_line_breaks_and_nulls(spark, tmp_path):
    for i, bad in enumerate(("a\nb", "a\rb", None)):
        rows = spark.createDataFrame([(0, bad)], "line_no int, x string")
        with pytest.raises(Exception, match="exactly one line"):
            text.write_lines(rows, "x", str(tmp_path / f"bad{i}"))


def test_sink_of_no_rows(spark, tmp_path):
    text.write_lines(spark.createDataFrame([], "line_no int, x string"), "x", str(tmp_path / "none"))
    assert text.read_lines(spark, str(tmp_path / "none")).count() == 0


def manifest_files(tmp_path, trg_lines=3):
    sides = {}
    for split in ("train", "dev"):
        for side, n in (("src", 3), ("trg", trg_lines)):
            sides.setdefault(split, {})[side] = [
                put(tmp_path / f"{split}.{side}.{part}", [f"{split} {side} {part} {i}" for i in range(n)]) for part in "ab"
            ]
    return sides


def test_manifest_and_parallel_corpus(spark, tmp_path):
    manifest = manifest_files(tmp_path)
    path = tmp_path / "data.yaml"
    path.write_text(json.dumps(manifest))
    loaded = corpora.load_manifest(str(path))
    assert loaded == manifest and corpora.manifest_rows(spark, loaded).count() == 8
    got = {(r["split"], r["line_no"]): (r["src"], r["trg"]) for r in corpora.read_parallel(spark, loaded).collect()}
    assert len(got) == 12
    assert got["dev", 4] == ("dev src b 1", "dev trg b 1") and got["train", 0] == ("train src a 0", "train trg a 0")


def test_unequal_sides_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no partner"):
        corpora.read_parallel(spark, manifest_files(tmp_path, trg_lines=4)).collect()


def test_manifest_refuses_the_same_file_on_both_sides(tmp_path):
    manifest = manifest_files(tmp_path)
    manifest["dev"]["trg"] = manifest["dev"]["src"]
    with pytest.raises(ValueError, match="same files"):
        corpora.check_manifest(manifest)
    manifest["dev"]["trg"] = "one.txt"
    with pytest.raises(ValueError, match="list of paths"):
        corpora.check_manifest(manifest)


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "good.jsonl", [json.dumps({"text": f"t{i}\nü", "summary": f"s{i}"}) for i in range(4)])
    assert corpora.read_jsonl(spark, good).count() == 4
    assert lines_of(corpora.read_numbered_jsonl(spark, good), "summary") == ["s0", "s1", "s2", "s3"]
    bad = put(tmp_path / "bad.jsonl", ['{"text": "a", "summary": "b"}', '{"text": '])
    for reader in (corpora.read_jsonl, corpora.read_numbered_jsonl):
        with pytest.raises(Exception):
            reader(spark, bad).collect()


def test_step_predictions(spark, tmp_path):
    for step in (500, 1000):
        put(tmp_path / f"dev.step_{step}.pred", [f"{step} {i}" for i in range(4)])
    put(tmp_path / "eval.pred.trg", ["ignored"])
    put(tmp_path / "dev.step_500.pred.tmp", ["still being written"])
    found = corpora.find_step_predictions(spark, str(tmp_path))
    assert sorted(found) == [500, 1000]
    rows = {(r["step"], r["line_no"]): r["hyp"] for r in corpora.read_step_predictions(spark, found).collect()}
    assert rows == {(s, i): f"{s} {i}" for s in (500, 1000) for i in range(4)}


def test_stream_equals_batch_over_two_arrivals(spark, tmp_path):
    watched, state, progress = tmp_path / "run", str(tmp_path / "state"), str(tmp_path / "progress")
    watched.mkdir()
    refs = [f"the reference line number {i} is here" for i in range(20)]
    references = spark.createDataFrame(list(enumerate(refs)), "line_no int, ref string")
    metrics = [Bleu(), Chrf(), Ter()]

    def arrive(step, cut):
        put(tmp_path / f"part.{step}", [r[:cut] for r in refs])
        os.rename(tmp_path / f"part.{step}", watched / f"dev.step_{step}.pred")

    arrive(500, 12)
    watch_steps(str(watched), references, metrics, state, progress).awaitTermination()
    assert [r["step"] for r in step_scores(spark, state, metrics).collect()] == [500]
    arrive(1000, 22)
    arrive(1500, 99)
    watch_steps(str(watched), references, metrics, state, progress).awaitTermination()
    live = {r["step"]: r.asDict() for r in step_scores(spark, state, metrics).collect()}
    files = corpora.find_step_predictions(spark, str(watched))
    batch = {r["step"]: r.asDict() for r in jobs.score_step_files(spark, files, references, metrics).collect()}
    assert live == batch and live[1500]["bleu"] == pytest.approx(100) and live[500]["chrf"] < live[1000]["chrf"]


def test_translate_and_summarize_jobs(spark, tmp_path):
    source = put(tmp_path / "in.txt", ["eins zwei", "", "drei"])

    def last_word():
        return lambda batch: [" ".join(tokens[-2:]) + "\nnext " for tokens in batch]

    jobs.translate(spark, source, str(tmp_path / "out"), last_word, "Translate:", max_length=4, batch_size=2)
    got = lines_of(text.read_lines(spark, str(tmp_path / "out")))
    assert got == ["zwei <|assistant|> next", "Translate: <|assistant|> next", "drei <|assistant|> next"]

    records = put(tmp_path / "in.jsonl", [json.dumps({"text": f"word{i} more", "summary": f"word{i}"}) for i in range(5)])

    def first_word():
        return lambda batch: [p.split("<|user|>\n")[1].split()[0] + "\n" for p in batch]

    scored = jobs.summarize(spark, records, str(tmp_path / "sum"), first_word, "1", batch_size=2)
    assert [r["rouge1"] for r in scored.collect()] == [1.0] * 5
    assert lines_of(text.read_lines(spark, str(tmp_path / "sum"))) == [f"batch:{i // 2}\tword{i}" for i in range(5)]
    spread = jobs.rouge_summary(scored, F.col("line_no"), 50).first()
    assert spread["rouge1_mid"] == 1.0


def test_report_is_tall(spark, tmp_path):
    wide = spark.createDataFrame([("en", 1.5, 2)], "lang string, bleu double, n int")
    reports.write_report(wide, str(tmp_path / "r"), ["lang"])
    rows = {tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert rows == {("en", "bleu", 1.5), ("en", "n", 2.0)}


def test_translation_report_lowercase_and_ter(spark):
    pairs = spark.createDataFrame([(" The cat sat on it ", "the CAT sat on it")], "hyp string, ref string")
    rows = {(r["section"], r["name"]): r["value"] for r in jobs.translation_report(pairs, lowercase=True, ter=True).collect()}
    assert rows["score", "bleu"] == pytest.approx(100) and rows["score", "ter"] == 0
    assert rows["overlap", "both_share"] == 1 and rows["top_ref", "cat"] == 1
