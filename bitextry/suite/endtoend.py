"""Queries over checkpoint analytics, inference, composed jobs and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.operators import checkpoints
from bitextry.operators.inference import predict as run_predictor
from bitextry.operators.scoring import Bleu, Chrf, corpus_scores
from bitextry.operators.vocabulary import prepare
from bitextry.plans import jobs, views
from bitextry.plans.views import with_views
from bitextry.session import scratch_path
from bitextry.sources import text
from bitextry.sources.reports import tall
from bitextry.streaming.early_stop import run_outcomes, watch_runs
from bitextry.streaming.step_metrics import step_scores, watch_steps
from bitextry.suite import sql
from bitextry.suite.files import numbered_pairs, written, written_steps
from bitextry.suite.metrics import BLEU_DOUBLES, STEP_METRICS, STEP_SQL, rounded
from bitextry.suite.registry import query
from bitextry.suite.selection import COUNTS_SQL, OVERLAP_SQL, TOKENS_SQL, TOP_SQL
from bitextry.suite.texts import CHAT_INSTRUCTION, INSTRUCTION
from bitextry.suite.tokens import REPAIRED_SQL, VOCAB_SIZE, damaged_ids, shown

THRESHOLD, PATIENCE = 0.05, 10


def _counted_sql(source: str, runs: str, value: str) -> str:
    """The patience counter of ``source``; lower values are better."""
    return f"""select *, evaluation - max(case when improved then evaluation end) over
                 (partition by {runs} order by step rows unbounded preceding) counter
        from (select *, best is null or coalesce({value} < best - {THRESHOLD}, false) improved from
          (select *, row_number() over (partition by {runs} order by step) evaluation,
                  min({value}) over (partition by {runs} order by step rows between unbounded preceding and 1 preceding) best
           from {source}))"""


@query(
    with_views(
        "select run, min_by(step, (eval_loss, step)) best_step, min(eval_loss) best_value from metric_log group by run",
        "metric_log",
    )
)
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.best_checkpoint(views.metric_log(spark, sf_dir))


@query(
    with_views(
        "select run, step, eval_loss, evaluation, improved, counter from counted",
        "metric_log",
        counted=_counted_sql("metric_log", "run", "eval_loss"),
    )
)
def patience_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.patience_counter(views.metric_log(spark, sf_dir), threshold=THRESHOLD)


@query(
    with_views(
        f"select run, coalesce(min(case when counter >= {PATIENCE} then step end), -1) stop_step from counted group by run",
        "metric_log",
        counted=_counted_sql("metric_log", "run", "eval_loss"),
    )
)
def early_stop_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = checkpoints.patience_counter(views.metric_log(spark, sf_dir), threshold=THRESHOLD)
    return checkpoints.early_stop_step(counted, PATIENCE).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


_TRACKED = f"{BLEU_DOUBLES} chrf"


@query(
    with_views(
        """select lang, metric, best_step, round(-best, 6) best_value, stop_step from
             (select lang, metric, min_by(step, (loss, step)) best_step, min(loss) best from log group by all)
           join (select lang, metric, coalesce(min(case when counter >= 2 then step end), -1) stop_step from counted group by all)
           using (lang, metric)""",
        "step_pairs",
        **sql.bleu("step_pairs", "lang, step", "doc_id, line_no"),
        **sql.chrf("step_pairs", "lang, step", "doc_id, line_no"),
        scored="select * from bleu join c_chrf using (lang, step)",
        log=" union all ".join(f"select lang, step, '{m}' metric, -round({m}, 6) loss from scored" for m in _TRACKED.split()),
        counted=_counted_sql("log", "lang, metric", "loss"),
    )
)
def checkpoint_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every language as a run: best step, and where patience ends after two flat evaluations."""
    scores = corpus_scores(views.step_pairs(spark, sf_dir), [Bleu(), Chrf()], by=["lang", "step"])
    log = tall(rounded(scores).drop("ref_len", "sys_len"), ["lang", "step"])
    tracked = jobs.track_checkpoints(log, "value", THRESHOLD, 2, True, ["lang", "metric"])
    return rounded(tracked).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


@query(
    with_views(
        """select metric, best_step, round(case when metric = 'ter' then best else -best end, 6) best_value, stop_step from
             (select metric, min_by(step, (loss, step)) best_step, min(loss) best from log group by all)
           join (select metric, coalesce(min(case when counter >= 2 then step end), -1) stop_step from counted group by all)
           using (metric)""",
        "step_pairs",
        scored=f"select * from ({STEP_SQL})",
        log=" union all ".join(
            f"select step, '{m.name}' metric, {'-' if m.greater_is_better else ''}{m.name} loss from scored" for m in STEP_METRICS
        ),
        counted=_counted_sql("log", "metric", "loss"),
    )
)
def track_step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best step and early stop of each metric, word edits included, from the prediction files of a folder."""
    base, refs = written_steps(spark, sf_dir, "tracked")
    tracked = jobs.track_step_files(spark, base, refs, STEP_METRICS, THRESHOLD, 2)
    return rounded(tracked).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


def reversing_words():
    """A toy translator: the words of each input in reverse."""
    return lambda batch: [" ".join(reversed(text.split(" "))) for text in batch]


@query(with_views("select doc_id, line_no, array_to_string(list_reverse(string_split(line, ' ')), ' ') hyp from lines", "lines"))
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_predictor(views.lines(spark, sf_dir), reversing_words, "line", "hyp")
    return made.select("doc_id", "line_no", "hyp")


def reversing_tokens():
    return lambda batch: [" ".join(reversed(list(tokens))) + "\n" for tokens in batch]


_RENDERED = f"'<|user|>' || chr(10) || {sql.literal(CHAT_INSTRUCTION)} || chr(10) || ref || chr(10) || '<|assistant|>' || chr(10)"


@query(
    with_views(
        f"""select row_number() over (order by doc_id, line_no) - 1 line_no,
                   {sql.strip("array_to_string(list_reverse(t[greatest(len(t) - 128, 0) + 1:]), ' ')")} as text
            from (select *, {sql.words(_RENDERED)} t from pairs)""",
        "pairs",
    )
)
def translate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = written(numbered_pairs(spark, sf_dir, "ref"), "ref", "source"), scratch_path(spark, "translated")
    jobs.translate(spark, source, out, reversing_tokens, CHAT_INSTRUCTION)
    return text.read_lines(spark, out)


def first_words():
    """A toy summarizer: the first 19 words of the user message."""

    def summarize(prompts: list[str]) -> list[str]:
        articles = (p.split("<|user|>\n", 1)[1].rsplit("\n<|assistant|>\n", 1)[0] for p in prompts)
        return [" ".join(a.replace("\n", " ").split(" ")[:19]) for a in articles]

    return summarize


@query(
    with_views(
        """select line_no, 'batch:' || line_no // 8 batch, hyp summary, round(rouge1, 6) rouge1, round(rouge2, 6) rouge2,
                  round("rougeL", 6) "rougeL" from made join rouge using (doc_id)""",
        "summ",
        made="""select doc_id, row_number() over (order by doc_id) - 1 line_no, summary,
                       array_to_string(string_split(replace(substring(text, 1, 10000), chr(10), ' '), ' ')[1:19], ' ') hyp
                from summ""",
        **sql.rouge("made", "doc_id"),
    )
)
def summarize_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = scratch_path(spark, "articles"), scratch_path(spark, "summaries")
    records = views.summaries(spark, sf_dir).select("doc_id", F.to_json(F.struct("text", "summary")).alias("record"))
    text.write_lines(records, "record", source, "doc_id")
    scored = jobs.summarize(spark, source, out, first_words, prompt_choice="2", batch_size=8)
    cells = F.split("text", "\t", 2)
    tagged = text.read_lines(spark, out).select("line_no", cells[0].alias("batch"), cells[1].alias("summary"))
    return rounded(tagged.join(scored.drop("hyp"), "line_no"))


REPORT_SCORES = f"{BLEU_DOUBLES} ref_len sys_len chrf"


def _tall_sql(source: str, section: str, names: str) -> str:
    return " union all ".join(
        f"select lang, '{section}' section, 0 rank, '{n}' as name, round({n}::double, 6) as \"value\" from {source}"
        for n in names.split()
    )


REPORT_SQL = with_views(
    _tall_sql("both_scores", "score", REPORT_SCORES)
    + " union all "
    + _tall_sql(
        "overlap",
        "overlap",
        "ref_types hyp_types both_types ref_only_types hyp_only_types both_share ref_only_share hyp_only_share",
    )
    + f""" union all select lang, 'top_' || side, rank, token, n::double from ({TOP_SQL})
    union all select lang, 'only_' || side, rank::int, token, null from
      (select *, row_number() over (partition by lang, side order by token) rank from counts c
       where not exists (select 1 from counts o where o.lang = c.lang and o.token = c.token and o.side <> c.side))
      where rank <= 7""",
    "pairs",
    **sql.bleu("pairs", "lang", "doc_id, line_no"),
    **sql.chrf("pairs", "lang", "doc_id, line_no"),
    both_scores="select * from bleu join c_chrf using (lang)",
    toks=TOKENS_SQL,
    counts=COUNTS_SQL,
    overlap=OVERLAP_SQL,
)


@query(REPORT_SQL)
def translation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.translation_report(views.pairs(spark, sf_dir), ["lang"]))


@query(
    with_views(
        """select doc_id, line_no, array_to_string(s.ids[1:127] || [1], ' ') input_ids, len(s.ids[1:127]) + 1 n,
                  array_to_string(t.ids[1:127] || [1], ' ') labels
           from src_ids s join trg_ids t using (doc_id, line_no)""",
        "pairs",
        "vocab",
        prefixed=f"select doc_id, line_no, {sql.literal(INSTRUCTION)} || ' ' || hyp src, ref trg from pairs",
        src_ids=sql.encoded("prefixed", "doc_id, line_no", "src"),
        trg_ids=sql.encoded("prefixed", "doc_id, line_no", "trg"),
    )
)
def seq2seq_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.pairs(spark, sf_dir).select("doc_id", "line_no", F.col("hyp").alias("src"), F.col("ref").alias("trg"))
    rows = jobs.seq2seq_rows(pairs, views.vocabulary(spark, sf_dir), ["doc_id", "line_no"], INSTRUCTION, keep=[])
    return rows.select(
        "doc_id",
        "line_no",
        shown("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        shown("labels").alias("labels"),
    )


def _decoded(ids: str) -> str:
    return f"""select lang, doc_id, line_no, coalesce(string_agg(tok, ' ' order by i) filter (id > 2), '') t from
        (select lang, doc_id, line_no, unnest({ids}) x, generate_subscripts({ids}, 1) i from pred_ids)
        left join vocab on x = id group by all"""


@query(
    with_views(
        f"""select lang, {sql.rounded(BLEU_DOUBLES)}, ref_len, sys_len, round(chrf, 6) chrf, sys_len_avg, pred_min, pred_max, invalid_count
            from bleu join c_chrf using (lang) join health using (lang)""",
        "pred_ids",
        hyps=_decoded(REPAIRED_SQL),
        refs=_decoded("true_ids"),
        texts="select lang, doc_id, line_no, h.t hyp, r.t ref from hyps h join refs r using (lang, doc_id, line_no)",
        health=f"""select lang, round(avg(len(list_filter({REPAIRED_SQL}, lambda x: x <> 0))), 6) sys_len_avg, min(list_min(ids)) pred_min,
                     max(list_max(ids)) pred_max,
                     sum(len(list_filter(ids, lambda x: x < 0 or x >= {VOCAB_SIZE})))::bigint invalid_count
                   from pred_ids group by lang""",
        **sql.bleu("texts", "lang", "doc_id, line_no", "exp"),
        **sql.chrf("texts", "lang", "doc_id, line_no"),
    )
)
def score_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = prepare(views.vocabulary(spark, sf_dir))
    # Ids as a model's floats, and labels that end in masked positions.
    floats = F.transform("ids", lambda x: x + F.lit(0.4).cast("double"))
    masked = F.concat("true_ids", F.array(F.lit(-100), F.lit(-100)))
    rows = damaged_ids(spark, sf_dir, vocab).select(
        "doc_id", "lang", "line_no", floats.alias("ids"), masked.alias("labels")
    )
    return rounded(jobs.score_ids(rows, vocab, ["doc_id", "line_no"], VOCAB_SIZE, ["lang"]))


@query(STEP_SQL)
def stream_step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's answer after it has caught up; the batch answer is ``metrics_by_step``."""
    base, refs = written_steps(spark, sf_dir, "stream")
    state = scratch_path(spark, "state")
    watch_steps(base, refs, STEP_METRICS, state, scratch_path(spark, "progress"), stored=True).awaitTermination()
    return rounded(step_scores(spark, state, STEP_METRICS))


@query(
    with_views(
        f"""select run, min_by(step, (eval_loss, step))::bigint best_step, min(eval_loss) best_value,
                   coalesce(min(case when counter >= {PATIENCE} then step end), -1)::bigint stop_step,
                   count(*) evaluations, max_by(counter, step) counter
            from counted group by run""",
        "metric_log",
        counted=_counted_sql("metric_log", "run", "eval_loss"),
    )
)
def stream_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric log as a stream whose micro-batches mix early and late steps; the batch answers are the checkpoint queries."""
    log, state = scratch_path(spark, "log"), scratch_path(spark, "runs")
    views.metric_log(spark, sf_dir).repartition(4, F.xxhash64("run", "step")).write.parquet(log)
    schema = spark.read.parquet(log).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(log)
    watch_runs(arriving, state, scratch_path(spark, "progress"), threshold=THRESHOLD, patience=PATIENCE).awaitTermination()
    return run_outcomes(spark, state).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))
