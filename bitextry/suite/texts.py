"""Queries over projections: prompts, chat messages and text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.functions import chat, strings
from bitextry.operators.prompts import SYSTEM_PROMPTS, sft_rows, summary_messages, with_system_prompt
from bitextry.plans import views
from bitextry.plans.views import with_views
from bitextry.suite import sql
from bitextry.suite.registry import query

INSTRUCTION = "translate German to English:"
CHAT_INSTRUCTION = "Translate the following text."
TASK_PREFIX = "runs_task_de-en_"


@query(
    with_views(
        f"select doc_id, line_no, {sql.literal(INSTRUCTION)} || ' ' || line prefixed, ' ' || line bare from lines", "lines"
    )
)
def instruction_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select(
        "doc_id",
        "line_no",
        strings.instruction_prefix("line", INSTRUCTION).alias("prefixed"),
        strings.instruction_prefix("line").alias("bare"),
    )


@query(
    with_views(
        f"select conv_id, turn, 1 messages, 'user' role, {sql.literal(CHAT_INSTRUCTION)} || chr(10) || src content from chat",
        "chat",
    )
)
def user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = chat.user_prompt("src", CHAT_INSTRUCTION)
    rows = views.chat(spark, sf_dir).select("conv_id", "turn", prompt.alias("p"))
    return rows.select("conv_id", "turn", F.size("p").alias("messages"), F.inline("p"))


@query(with_views("select conv_id, turn, 1 messages, 'assistant' role, trg content from chat", "chat"))
def assistant_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.chat(spark, sf_dir).select("conv_id", "turn", chat.assistant_completion("trg").alias("c"))
    return rows.select("conv_id", "turn", F.size("c").alias("messages"), F.inline("c"))


@query(
    with_views(
        f"""select conv_id, turn, src, trg, 'user' prompt_role, {sql.literal(CHAT_INSTRUCTION)} || chr(10) || src prompt_content,
                   'assistant' completion_role, trg completion_content from chat""",
        "chat",
    )
)
def sft_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sft_rows(views.chat(spark, sf_dir), CHAT_INSTRUCTION)
    return rows.select(
        "conv_id",
        "turn",
        "src",
        "trg",
        F.col("prompt")[0]["role"].alias("prompt_role"),
        F.col("prompt")[0]["content"].alias("prompt_content"),
        F.col("completion")[0]["role"].alias("completion_role"),
        F.col("completion")[0]["content"].alias("completion_content"),
    )


_CATALOG = ", ".join(f"({sql.literal(k)}, {sql.literal(v)})" for k, v in SYSTEM_PROMPTS.items())
_PROMPTED = f"(select *, (doc_id % 4 + 1)::varchar prompt_id from documents) d join (values {_CATALOG}) c(prompt_id, system_prompt) using (prompt_id)"


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir).withColumn("prompt_id", (F.col("doc_id") % 4 + 1).cast("string"))
    return with_system_prompt(docs, "prompt_id")


@query(f"select doc_id, prompt_id, system_prompt from {_PROMPTED}")
def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompted(spark, sf_dir).select("doc_id", "prompt_id", "system_prompt")


@query(
    f"""select doc_id, 'system' system_role, system_prompt system_content, 'user' user_role,
               substring(text, 1, 10000) user_content from {_PROMPTED}"""
)
def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return summary_messages(_prompted(spark, sf_dir)).select(
        "doc_id",
        m[0]["role"].alias("system_role"),
        m[0]["content"].alias("system_content"),
        m[1]["role"].alias("user_role"),
        m[1]["content"].alias("user_content"),
    )


@query("select doc_id, substring(text, 1, 10000) limited, length(substring(text, 1, 10000)) n from documents")
def char_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = strings.char_limit("text").alias("limited")
    return views.documents(spark, sf_dir).select("doc_id", limited).withColumn("n", F.length("limited").cast("bigint"))


@query(
    with_views(
        f"""select conv_id, turn,
              '<|user|>' || chr(10) || p || chr(10) || '<|assistant|>' || chr(10) prompt_text,
              '<|user|>' || chr(10) || p || chr(10) || '<|assistant|>' || chr(10) || trg || chr(10) full_text
            from (select *, {sql.literal(CHAT_INSTRUCTION)} || chr(10) || src p from chat)""",
        "chat",
    )
)
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.ChatTemplate()
    rows = sft_rows(views.chat(spark, sf_dir), CHAT_INSTRUCTION)
    return rows.select(
        "conv_id",
        "turn",
        template.render("prompt").alias("prompt_text"),
        template.render(F.concat("prompt", "completion"), add_generation_prompt=False).alias("full_text"),
    )


_EDGED = "(select doc_id, line_no, chr(160) || chr(9) || line || ' ' || chr(12288) || chr(10) padded from lines)"


@query(with_views(f"select doc_id, line_no, {sql.strip('padded')} stripped from {_EDGED}", "lines"))
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\u00a0\t"), "line", F.lit(" \u3000\n"))
    return views.lines(spark, sf_dir).select("doc_id", "line_no", strings.strip(padded).alias("stripped"))


@query(
    with_views(
        f"select doc_id, line_no, lower({sql.strip('line')}) lowered, {sql.strip('line')} kept from lines", "lines"
    )
)
def lowercase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select(
        "doc_id",
        "line_no",
        strings.normalize_line("line", lowercase=True).alias("lowered"),
        strings.normalize_line("line").alias("kept"),
    )


@query(f"select doc_id, replace({sql.strip('chr(10) || text || chr(9)')}, chr(10), ' ') cleaned from documents")
def clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("\n"), "text", F.lit("\t"))
    return views.documents(spark, sf_dir).select("doc_id", strings.clean_output(made).alias("cleaned"))


@query(
    f"""select doc_id, slug,
               case when instr(slug, {sql.literal(TASK_PREFIX)}) > 0
                    then substr(slug, 1, instr(slug, {sql.literal(TASK_PREFIX)}) - 1)
                         || substr(slug, instr(slug, {sql.literal(TASK_PREFIX)}) + {len(TASK_PREFIX)})
                    else slug end short_slug
        from (select doc_id, replace(replace('runs/task/de-en/models_' || lang || '/run' || doc_id, '/', '_'), 'models_', '') slug
              from documents)"""
)
def run_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("runs/task/de-en/models_"), "lang", F.lit("/run"), "doc_id")
    return views.documents(spark, sf_dir).select(
        "doc_id", strings.run_slug(path).alias("slug"), strings.run_slug(path, TASK_PREFIX).alias("short_slug")
    )
