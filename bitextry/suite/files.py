"""Queries over sources and sinks: each writes a view of the tables to files and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.operators.align import align, pair_with_references
from bitextry.operators.numbering import with_ordinal
from bitextry.operators.scoring import Bleu, Chrf, corpus_scores
from bitextry.plans import views
from bitextry.plans.views import with_views
from bitextry.session import checkpointed, scratch_path
from bitextry.sources import corpora, reports, text
from bitextry.suite.registry import query

LANGS = ("en", "fr", "de", "es")
TRAIN, DEV = ("en", "fr"), ("de", "es")


def numbered_pairs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``row_no`` in document order, with the given columns of the pairs."""
    rows = views.pairs(spark, sf_dir).select("doc_id", "line_no", *columns)
    return with_ordinal(rows, ["doc_id", "line_no"])


def written(df: DataFrame, column: str, label: str, order_by: str = "row_no") -> str:
    path = scratch_path(df.sparkSession, label)
    text.write_lines(df, column, path, order_by)
    return path


ALL_LINES = "select row_number() over (order by doc_id, line_no) - 1 line_no, {0} from pairs"


@query(with_views(ALL_LINES.format("ref as text"), "pairs"))
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_lines(spark, written(numbered_pairs(spark, sf_dir, "ref"), "ref", "scan"))


@query(with_views(ALL_LINES.format("hyp as text"), "pairs"))
def line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_lines(spark, written(numbered_pairs(spark, sf_dir, "hyp"), "hyp", "sink"))


def _by_language(spark: SparkSession, sf_dir: str, label: str) -> tuple[str, DataFrame]:
    """Both sides as files per language: ``{base}/{side}.{lang}``."""
    base, rows = scratch_path(spark, label), numbered_pairs(spark, sf_dir, "lang", "hyp", "ref")
    for lang in LANGS:
        for side, column in (("src", "ref"), ("trg", "hyp")):
            text.write_lines(rows.filter(F.col("lang") == lang), column, f"{base}/{side}.{lang}", "row_no")
    return base, rows


def _manifest(base: str) -> corpora.Manifest:
    return {
        split: {side: [f"{base}/{side}.{lang}" for lang in langs] for side in corpora.SIDES}
        for split, langs in (("train", TRAIN), ("dev", DEV))
    }


_ORDER = "case lang when 'en' then 0 when 'fr' then 1 when 'de' then 0 else 1 end"
_SPLIT = "case when lang in ('en', 'fr') then 'train' else 'dev' end"


@query(
    with_views(
        f"""select {_SPLIT} split, side, ({_ORDER})::int file_ord, side || '.' || lang as name, count(*) lines
            from pairs, (values ('src'), ('trg')) s(side) group by all""",
        "pairs",
    )
)
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a manifest, with the lines of each file."""
    base, _ = _by_language(spark, sf_dir, "manifest")
    rows = corpora.manifest_rows(spark, _manifest(base)).withColumn("name", F.substring_index("path", "/", -1))
    files = {f"{side}.{lang}": [f"{base}/{side}.{lang}"] for side in corpora.SIDES for lang in LANGS}
    counts = text.scan_groups(spark, files).groupBy(F.col("group").alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    return rows.join(counts, "name").select("split", "side", "file_ord", "name", "lines")


@query(
    with_views(
        f"""select {_SPLIT} split, row_number() over (partition by {_SPLIT} order by {_ORDER}, doc_id, line_no) - 1 line_no,
                   ref src, hyp trg from pairs""",
        "pairs",
    )
)
def parallel_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _by_language(spark, sf_dir, "parallel")
    return corpora.read_parallel(spark, _manifest(base))


@query(
    with_views(
        f"select row_number() over (order by {_SPLIT} desc, {_ORDER}, doc_id, line_no) - 1 line_no, ref as text from pairs",
        "pairs",
    )
)
def file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _by_language(spark, sf_dir, "union")
    return text.read_lines(spark, [f"{base}/src.{lang}" for lang in LANGS])


@query(with_views("select text, summary from summ", "summ"))
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    views.summaries(spark, sf_dir).select("text", "summary").write.json(path)
    return corpora.read_jsonl(spark, path)


@query(
    with_views(
        """select n line_no, 'batch:' || (n // 16) batch, hyp summary from
           (select row_number() over (order by doc_id) - 1 n, hyp from summ)""",
        "summ",
    )
)
def batch_tsv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = with_ordinal(views.summaries(spark, sf_dir).select("doc_id", "hyp"), ["doc_id"]), scratch_path(spark, "tsv")
    text.write_batch_tagged(rows, "hyp", path, 16, "row_no")
    cells = F.split("text", "\t", 2)
    return text.read_lines(spark, path).select("line_no", cells[0].alias("batch"), cells[1].alias("summary"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_no, line`` in document order, as a stored table.

    Where ids tell documents apart the lines are sorted with their text, once. Else numbers are given to keys, and
    lines meet them by key.
    """
    lines = views.lines(spark, sf_dir)
    ids = views.documents(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        placed = with_ordinal(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"], compression="zstd")
        return placed.select("row_no", "line")
    rows = with_ordinal(lines.select("doc_id", "line_no"), ["doc_id", "line_no"])
    return checkpointed(lines.join(rows, ["doc_id", "line_no"]).select("row_no", "line"), "zstd")


def written_steps(spark: SparkSession, sf_dir: str, label: str) -> tuple[str, DataFrame]:
    """A folder of ``dev.step_{N}.pred``, their part files compressed, and the references ``line_no, ref``."""
    base, numbered = scratch_path(spark, label), numbered_lines(spark, sf_dir)
    for step in views.STEPS:
        made = numbered.select("row_no", views.predicted(F.col("line"), F.lit(step)).alias("hyp"))
        text.write_lines(made, "hyp", f"{base}/dev.step_{step}.pred", "row_no", compression="gzip")
    return base, numbered.select(F.col("row_no").alias("line_no"), F.col("line").alias("ref"))


@query(
    with_views(
        """select step, row_number() over (partition by step order by doc_id, line_no) - 1 line_no, hyp from step_pairs""",
        "step_pairs",
    )
)
def step_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = written_steps(spark, sf_dir, "steps")
    return corpora.read_step_predictions(spark, corpora.find_step_predictions(spark, base))


@query(with_views("select doc_id, line_no, ref src, hyp trg from pairs", "pairs"))
def align_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.pairs(spark, sf_dir)
    src = rows.select("doc_id", "line_no", F.col("ref").alias("src"))
    trg = rows.select("doc_id", "line_no", F.col("hyp").alias("trg"))
    return align(src, trg, ["doc_id", "line_no"])


@query(with_views(ALL_LINES.format("hyp, ref"), "pairs"))
def hyp_ref_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_pairs(spark, sf_dir, "hyp", "ref")
    hyps, refs = (text.read_lines(spark, written(rows, side, side), side) for side in ("hyp", "ref"))
    return pair_with_references(hyps, refs)


def _metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    scores = corpus_scores(views.pairs(spark, sf_dir), [Bleu(), Chrf()], by=["lang"])
    reports.write_report(scores, path, ["lang"])
    stored = spark.read.parquet(path)
    return stored.select("lang", "metric", F.round("value", 6).alias("value"))
