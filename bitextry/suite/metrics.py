"""Queries over corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.operators import scoring
from bitextry.operators.scoring import Bleu, Chrf, Ter, corpus_scores
from bitextry.plans import jobs, views
from bitextry.plans.views import with_views
from bitextry.functions.draws import COUNTER_STEP
from bitextry.operators.bootstrap import poisson_thresholds
from bitextry.suite import sql
from bitextry.suite.files import _metric_report, written_steps
from bitextry.suite.registry import query
from bitextry.functions.strings import percent
from bitextry.sources import corpora
from bitextry.sources.reports import formatted_record

BLEU_DOUBLES = "bleu bleu_p1 bleu_p2 bleu_p3 bleu_p4 bleu_bp"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _bleu_sql(smooth: str) -> str:
    return with_views(
        f"select lang, {sql.rounded(BLEU_DOUBLES)}, ref_len, sys_len from bleu",
        "pairs",
        **sql.bleu("pairs", "lang", "doc_id, line_no", smooth),
    )


@query(_bleu_sql("none"))
def bleu_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [Bleu()], by=["lang"]))


@query(_bleu_sql("exp"))
def bleu_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [Bleu(smooth="exp")], by=["lang"]))


@query(
    with_views("select lang, round(chrf, 6) chrf from c_chrf", "pairs", **sql.chrf("pairs", "lang", "doc_id, line_no"))
)
def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [Chrf()], by=["lang"]))


# A hypothesis of ``pairs`` is its reference with words left out or replaced by a word that no reference has, so no
# shift helps, and the words that are kept need no edit.
_KEPT = "len([x for x in h if x <> 'zzz'])"


def _edits_sql(by: str, name: str, source: str) -> str:
    return with_views(
        f"""select {by}, round(100.0 * sum(edits) / sum(words), 6) {name}, sum(edits)::bigint {name}_edits,
                   sum(words)::double {name}_ref_words from edited group by {by}""",
        source,
        edited=f"select {by}, len(r) - {_KEPT} edits, len(r) words from (select *, {sql.words('hyp')} h, {sql.words('ref')} r from {source})",
    )


@query(_edits_sql("lang", "ter", "pairs"))
def ter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [Ter()], by=["lang"]))


@query(
    with_views(
        """select lang, round(100.0 * sum((n >= 8)::int) / sum(n), 6) ter, sum((n >= 8)::int)::bigint ter_edits,
                  sum(n)::double ter_ref_words from (select lang, len(string_split(line, ' ')) n from lines) group by lang""",
        "lines",
    )
)
def ter_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least eight words in which words 1-3 and 4-6 have changed places: one shift each."""
    tagged = F.transform(F.split("line", " "), lambda w, i: F.concat_ws("_", w, i.cast("string")))
    swapped = F.concat(F.slice("words", 4, 3), F.slice("words", 1, 3), F.slice("words", 7, F.size("words")))
    rows = views.lines(spark, sf_dir).withColumn("words", tagged)
    moved = F.when(F.size("words") >= 8, swapped).otherwise(F.col("words"))
    rows = rows.select("lang", F.array_join(moved, " ").alias("hyp"), F.array_join("words", " ").alias("ref"))
    return rounded(corpus_scores(rows, [Ter()], by=["lang"]))


PLAIN_EDITS = Ter(shifts=False, case_sensitive=True, name="word_edit_rate")


@query(_edits_sql("lang", "word_edit_rate", "pairs"))
def word_edit_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [PLAIN_EDITS], by=["lang"]))


@query(
    with_views(
        f"""select doc_id, line_no, (len(r) - {_KEPT})::bigint edits, len(r)::double ref_words
            from (select *, {sql.words('hyp')} h, {sql.words('ref')} r from pairs)""",
        "pairs",
    )
)
def word_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scoring.row_statistics(views.pairs(spark, sf_dir), [PLAIN_EDITS], "hyp", "ref", ["doc_id", "line_no"])
    return stats.select(
        "doc_id",
        "line_no",
        F.col("word_edit_rate__edits").alias("edits"),
        F.col("word_edit_rate__ref_words").alias("ref_words"),
    )


@query(
    with_views(
        f"""select round(100.0 * sum(edits) / sum(words), 6) word_edit_rate, sum(edits)::bigint word_edit_rate_edits,
                   sum(words)::double word_edit_rate_ref_words
            from (select len(r) - {_KEPT} edits, len(r) words
                  from (select {sql.words('hyp')} h, {sql.words('ref')} r from pairs))""",
        "pairs",
    )
)
def word_edit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(corpus_scores(views.pairs(spark, sf_dir), [PLAIN_EDITS]))


def _rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rouge_scores(views.pairs(spark, sf_dir).select("doc_id", "line_no", "hyp", "ref"))


def _rouge_sql(body: str, **extra: str) -> str:
    return with_views(body, "pairs", **sql.rouge("pairs", "doc_id, line_no", "ref", "zzz"), **extra)


@query(_rouge_sql("select doc_id, line_no, round(rouge1, 6) rouge1, round(rouge2, 6) rouge2 from rouge"))
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rouge(spark, sf_dir).select("doc_id", "line_no", "rouge1", "rouge2"))


@query(_rouge_sql('select doc_id, line_no, round("rougeL", 6) "rougeL" from rouge'))
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_rouge(spark, sf_dir).select("doc_id", "line_no", "rougeL"))


@query(
    _rouge_sql(
        'select count(*) n, round(avg(rouge1), 6) rouge1, round(avg(rouge2), 6) rouge2, round(avg("rougeL"), 6) "rougeL" from rouge'
    )
)
def rouge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _rouge(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *(F.avg(t).alias(t) for t in scoring.ROUGE_TYPES))
    return rounded(means)


REPLICATES = 1000
# A row's hash gives the two words that number its draws.
_WORDS = """select *, ('0x' || substr(m, 1, 8))::ubigint a, ('0x' || substr(m, 9, 8))::ubigint s
            from (select *, md5('42:' || doc_id || '-' || line_no) m from rouge)"""
_DRAWS = f"""select *, {sql.mixed(f"((s + k::ubigint * {COUNTER_STEP}::ubigint) & 4294967295::ubigint)", "i")},
             {sql.mixed("xor(a, i)", "x")} from ({_WORDS}), range(0, {REPLICATES}) t(k)"""
_WEIGHT = " + ".join(f"(x >= {t})::int" for t in poisson_thresholds())
_INTERVAL = ", ".join(
    f'round(quantile_cont("{t}", {p}), 6) "{t}_{name}"'
    for t in scoring.ROUGE_TYPES
    for name, p in (("low", 0.025), ("mid", 0.5), ("high", 0.975))
)


@query(
    _rouge_sql(
        f"select {_INTERVAL} from drawn",
        drawn=f"""select b, sum(w * rouge1) / sum(w) rouge1, sum(w * rouge2) / sum(w) rouge2, sum(w * "rougeL") / sum(w) "rougeL"
                  from (select *, k b, {_WEIGHT} w from ({_DRAWS})) group by b""",
    )
)
def rouge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "doc_id", "line_no")
    return rounded(jobs.rouge_summary(_rouge(spark, sf_dir), key, REPLICATES))


def _report_sql(names: str) -> str:
    return " union all ".join(f"select lang, '{n}' metric, round({n}::double, 6) as \"value\" from both_scores" for n in names.split())


@query(
    with_views(
        _report_sql(BLEU_DOUBLES + " ref_len sys_len chrf"),
        "pairs",
        **sql.bleu("pairs", "lang", "doc_id, line_no"),
        **sql.chrf("pairs", "lang", "doc_id, line_no"),
        both_scores="select * from bleu join c_chrf using (lang)",
    )
)
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_report(spark, sf_dir)


@query(
    with_views(
        """select lang, round(bleu, 2) bleu, round(chrf, 2) chrf, round(bleu_bp, 2) bp,
                  concat_ws('/', round(bleu_p1, 1), round(bleu_p2, 1), round(bleu_p3, 1), round(bleu_p4, 1)) precisions,
                  ref_len, sys_len, round(100.0 * sys_len / ref_len)::bigint || '%' share from both_scores""",
        "pairs",
        **sql.bleu("pairs", "lang", "doc_id, line_no", "exp"),
        **sql.chrf("pairs", "lang", "doc_id, line_no"),
        both_scores="select * from bleu join c_chrf using (lang)",
    )
)
def formatted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounded record of each language, with the generated share of the reference length in whole percent."""
    scores = corpus_scores(views.pairs(spark, sf_dir), [Bleu(smooth="exp"), Chrf()], by=["lang"])
    record = formatted_record(scores, ["lang"]).withColumn("precisions", F.array_join(F.col("precisions").cast("array<string>"), "/"))
    return record.withColumn("share", percent(F.col("sys_len") / F.col("ref_len")))


STEP_METRICS = (Bleu(), Chrf(), Ter())
STEP_SQL = with_views(
    f"""select step, {sql.rounded(BLEU_DOUBLES)}, ref_len, sys_len, round(chrf, 6) chrf,
               round(100.0 * edits / words, 6) ter, edits::bigint ter_edits, words::double ter_ref_words
        from bleu join c_chrf using (step) join edited using (step)""",
    "step_pairs",
    edited=f"""select step, sum(len(r) - {_KEPT}) edits, sum(len(r)) words
               from (select step, {sql.words('hyp')} h, {sql.words('ref')} r from step_pairs) group by step""",
    **sql.bleu("step_pairs", "step", "doc_id, line_no"),
    **sql.chrf("step_pairs", "step", "doc_id, line_no"),
)


@query(STEP_SQL)
def metrics_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, refs = written_steps(spark, sf_dir, "metrics")
    files = corpora.find_step_predictions(spark, base)
    return rounded(jobs.score_step_files(spark, files, refs, STEP_METRICS))


@query(_edits_sql("step", "ter", "step_pairs"))
def ter_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = views.step_pairs(spark, sf_dir)
    return rounded(corpus_scores(steps, [Ter()], by=["step"]))


SIGNED = {
    "bleu": "nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp",
    "chrf": "nrefs:1|case:mixed|eff:yes|nc:6|nw:0|space:no",
    "ter": "nrefs:1|case:lc|tok:none|shifts:yes",
}


@query(
    with_views(
        " union all ".join(
            f"select lang, '{m}' metric, round({m}, 6) as \"value\", '{text}' signature from scored" for m, text in SIGNED.items()
        ),
        "pairs",
        **sql.bleu("pairs", "lang", "doc_id, line_no", "exp"),
        **sql.chrf("pairs", "lang", "doc_id, line_no"),
        edited=f"""select lang, 100.0 * sum(len(r) - {_KEPT}) / sum(len(r)) ter
                   from (select lang, {sql.words('hyp')} h, {sql.words('ref')} r from pairs) group by lang""",
        scored="select * from bleu join c_chrf using (lang) join edited using (lang)",
    )
)
def signed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.signed_scores(views.pairs(spark, sf_dir), [Bleu(smooth="exp"), Chrf(), Ter()], ["lang"]))
