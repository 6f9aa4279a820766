"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextry.functions import arrays
from bitextry.functions.chat import ChatTemplate, user_prompt
from bitextry.functions.strings import clean_output, instruction_prefix, normalize_line, strip
from bitextry.functions.tokenizers import Tokenizer, tokenizer, whitespace_tokens
from bitextry.operators import checkpoints, scoring, vocabulary
from bitextry.operators.align import pair_steps_with_references
from bitextry.operators.bootstrap import bootstrap_interval, bootstrap_replicates
from bitextry.operators.inference import Predictor, predict
from bitextry.operators.prompts import summary_messages, with_system_prompt
from bitextry.session import checkpointed
from bitextry.sources.corpora import find_step_predictions, read_numbered_jsonl, read_step_predictions
from bitextry.sources.reports import tall
from bitextry.sources.text import read_lines, write_batch_tagged, write_lines


def translation_report(
    pairs: DataFrame,
    by: Sequence[str] = (),
    tokenize: str | Tokenizer = "13a",
    lowercase: bool = False,
    ter: bool = False,
) -> DataFrame:
    """``by..., section, rank, name, value``: scores, vocabulary overlap, top tokens, one-sided tokens.

    Two passes over the pairs: one for the row statistics of all metrics, one for the token counts.
    """
    by = list(by)
    lines = pairs.select(*by, *(normalize_line(side, lowercase).alias(side) for side in ("hyp", "ref")))
    metrics: list = [scoring.Bleu(tokenize=tokenize), scoring.Chrf()]
    if ter:
        metrics.append(scoring.Ter(case_sensitive=not lowercase))
    cut = tokenizer(tokenize)
    types = vocabulary.pair_types(lines, cut(F.col("ref")), cut(F.col("hyp")), by)

    def section(df: DataFrame, name: str | None = None, value: str = "value", key: str = "metric") -> DataFrame:
        label = F.lit(name) if name else F.concat(F.lit("top_" if value == "n" else "only_"), "side")
        rank = F.col("rank") if "rank" in df.columns else F.lit(0)
        number = F.col(value) if value in df.columns else F.lit(None)
        return df.select(
            *by, label.alias("section"), rank.alias("rank"), F.col(key).alias("name"), number.cast("double").alias("value")
        )

    return (
        section(tall(scoring.corpus_scores(lines, metrics, by=by), by), "score")
        .unionByName(section(tall(vocabulary.overlap_report(types, by), by), "overlap"))
        .unionByName(section(vocabulary.top_tokens(types, by=by), value="n", key="token"))
        .unionByName(section(vocabulary.exclusive_examples(types, by=by), value="none", key="token"))
    )


def seq2seq_rows(
    pairs: DataFrame,
    vocab: DataFrame | vocabulary.Vocabulary,
    keys: Sequence[str],
    instruction: str = "",
    max_length: int = 128,
    cut: Tokenizer = whitespace_tokens,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``input_ids, attention_mask, labels`` to ``src, trg`` rows for sequence-to-sequence training.

    With ``keep``, only these columns and ``keys`` stay beside the new ones. Tokens beyond ``max_length`` are cut before
    they are looked up, and both sides are looked up at once, so that rows of a large vocabulary move once.
    """
    vocab, room = vocabulary.prepare(vocab), max_length - 1
    kept = [c for c in pairs.columns if keep is None or c in keep or c in keys]
    none = F.array().cast("array<string>")
    sides = (("_in", cut(instruction_prefix("src", instruction))), ("_out", cut(F.col("trg"))))
    tokens = pairs.select(*kept, *(F.coalesce(arrays.truncate(cells, room), none).alias(name) for name, cells in sides))
    both = tokens.select(*kept, F.concat("_in", "_out").alias("_ids"), F.size("_in").alias("_size"))
    coded = vocabulary.encode(both, "_ids", vocab, keys, "_ids")

    def ended(ids: Column) -> Column:
        return F.concat(ids, F.array(F.lit(vocabulary.END_ID)))

    cut_rows = coded.select(
        *kept,
        ended(F.slice("_ids", F.lit(1), F.col("_size"))).alias("input_ids"),
        ended(F.slice("_ids", F.col("_size") + 1, F.greatest(F.size("_ids") - F.col("_size"), F.lit(0)))).alias("labels"),
    )
    return cut_rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def score_ids(
    df: DataFrame,
    vocab: DataFrame | vocabulary.Vocabulary,
    keys: Sequence[str],
    vocab_size: int,
    by: Sequence[str] = (),
    pad_id: int | None = vocabulary.PAD_ID,
    end_id: int | None = vocabulary.END_ID,
) -> DataFrame:
    """Validation record from predicted ``ids`` and ``labels``: BLEU, chrF, lengths and id health.

    ``ids`` may also be the scores of all ids at each position, of which the best is taken, or floats, which are rounded.
    """
    by, vocab = list(by), vocabulary.prepare(vocab)
    element = df.schema["ids"].dataType.elementType
    if isinstance(element, T.ArrayType):
        df = df.withColumn("ids", arrays.argmax_ids("ids"))
    elif isinstance(element, (T.FloatType, T.DoubleType)):
        df = df.withColumn("ids", arrays.round_ids("ids"))
    pad_id = arrays.resolve_pad_id(pad_id, end_id)
    health = scoring.health_aggregates()
    rows = df.withColumns(scoring.health_columns("ids", vocab_size)).withColumns(
        {"ids": arrays.repair_ids("ids", vocab_size, pad_id), "labels": arrays.unmask_labels("labels", pad_id)}
    )
    rows = rows.withColumn("_non_pad", arrays.count_non_pad("ids", pad_id))
    for source, text in (("ids", "hyp"), ("labels", "ref")):
        rows = vocabulary.decode(rows, source, vocab, keys, text)
    lines = rows.withColumns({side: strip(side) for side in ("hyp", "ref")})
    metrics = [scoring.Bleu(smooth="exp"), scoring.Chrf()]
    carried = [*by, "_non_pad", *scoring.HEALTH_COLUMNS]
    stats = scoring.row_statistics(lines, metrics, by=carried)
    # One aggregation for everything, so the predictions are read once.
    sums = stats.groupBy(*by).agg(
        *(F.sum(n).alias(n) for n in stats.columns if n not in carried),
        F.avg("_non_pad").alias("sys_len_avg"),
        *(c.alias(n) for n, c in health.items()),
    )
    return scoring.close_scores(sums, metrics, [*by, "sys_len_avg", *health])


def metrics_by_step(steps: DataFrame, references: DataFrame, metrics: Sequence, by: Sequence[str] = ("step",)) -> DataFrame:
    """Scores of every evaluation step against the same references."""
    return scoring.corpus_scores(pair_steps_with_references(steps, references), metrics, by=by)


def track_checkpoints(
    log: DataFrame, value: str, threshold: float, patience: int, greater_is_better: bool, runs: Sequence[str] = ("run",)
) -> DataFrame:
    """Per run: the best step and value, and the step at which patience ran out."""
    best = checkpoints.best_checkpoint(log, value, greater_is_better, runs)
    counted = checkpoints.patience_counter(log, value, threshold, greater_is_better, runs)
    return best.join(checkpoints.early_stop_step(counted, patience, runs), list(runs), "left")


def score_step_files(spark: SparkSession, files: Mapping[int, Sequence[str]], references: DataFrame, metrics: Sequence) -> DataFrame:
    return metrics_by_step(read_step_predictions(spark, files), references, metrics)


def track_step_files(
    spark: SparkSession, folder: str, references: DataFrame, metrics: Sequence, threshold: float = 0.0, patience: int = 1
) -> DataFrame:
    """``metric, best_step, best_value, stop_step`` from the ``dev.step_{N}.pred`` files below ``folder``.

    Each metric is a run of its own and improves in its own direction. The files are scored once.
    """
    scores = score_step_files(spark, find_step_predictions(spark, folder), references, metrics)
    sign = F.when(F.col("metric").isin([m.name for m in metrics if not m.greater_is_better]), -1.0).otherwise(1.0)
    log = tall(scores.select("step", *(m.name for m in metrics)), ["step"]).withColumn("value", F.col("value") * sign)
    tracked = track_checkpoints(checkpointed(log), "value", threshold, patience, True, ["metric"])
    return tracked.withColumn("best_value", F.col("best_value") * sign)


def signed_scores(pairs: DataFrame, metrics: Sequence, by: Sequence[str] = (), references: int | str = 1) -> DataFrame:
    """``by..., metric, value, signature``: each score beside the settings that it depends on."""
    by = list(by)
    scores = scoring.corpus_scores(pairs, metrics, by=by).select(*by, *(m.name for m in metrics))
    signatures = F.create_map(*(F.lit(x) for m in metrics for x in (m.name, m.signature(references))))
    return tall(scores, by).withColumn("signature", signatures[F.col("metric")])


def translate(
    spark: SparkSession,
    source: str | Sequence[str],
    out: str,
    factory: Callable[[], Predictor],
    instruction: str,
    template: ChatTemplate = ChatTemplate(),
    cut: Tokenizer = whitespace_tokens,
    max_length: int = 128,
    batch_size: int = 16,
) -> None:
    """Translate text files line by line into ``out``, one output line per input line.

    The prompt is truncated on the left, so a long source can push its own instruction out.
    """
    lines = read_lines(spark, source)
    prompts = lines.select("line_no", cut(template.render(user_prompt("text", instruction))).alias("tokens"))
    inputs = prompts.select("line_no", arrays.truncate("tokens", max_length, "left").alias("tokens"))
    made = predict(inputs, factory, "tokens", "hyp", batch_size=batch_size)
    write_lines(made, clean_output("hyp"), out)


def summarize(
    spark: SparkSession,
    source: str,
    out: str,
    factory: Callable[[], Predictor],
    prompt_choice: str = "1",
    template: ChatTemplate = ChatTemplate(),
    batch_size: int = 1,
    limit: int = 10_000,
) -> DataFrame:
    """Summarize JSONL records into a batch-tagged file; returns ``line_no, hyp, rouge1, rouge2, rougeL``."""
    records = read_numbered_jsonl(spark, source).withColumn("prompt_id", F.lit(prompt_choice))
    prompts = summary_messages(with_system_prompt(records, "prompt_id"), limit=limit)
    inputs = prompts.select("line_no", "summary", template.render("messages").alias("prompt"))
    made = predict(inputs, factory, "prompt", "hyp", batch_size=batch_size).select("line_no", "summary", "hyp")
    # The predictions are read twice, so they are written once and scored from there.
    predictions = f"{out}.predictions"
    made.write.parquet(predictions)
    stored = spark.read.schema(made.schema).parquet(predictions)
    write_batch_tagged(stored, "hyp", out, batch_size)
    return scoring.rouge_scores(stored, "hyp", "summary").drop("summary")


def rouge_summary(scored: DataFrame, key, replicates: int = 1000, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Bootstrap median and interval of each ROUGE F-measure."""
    drawn = bootstrap_replicates(scored, scoring.ROUGE_TYPES, key, replicates, seed, by)
    return bootstrap_interval(drawn, scoring.ROUGE_TYPES, by=by)
