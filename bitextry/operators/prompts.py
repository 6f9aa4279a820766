"""Prompt and completion rows, and the catalog of summarization prompts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitextry.functions.chat import assistant_completion, system_and_user, user_prompt
from bitextry.functions.strings import char_limit

# The system prompts that summaries are asked for with.
SYSTEM_PROMPTS = {
    "1": "You are a helpful summarization agent. Please summarize the article below in less than 20 words",
    "2": "Please summarize the following news article in less than 20 words",
    "3": "You are a newspaper editor. Your job is to provide a sentence heading for the following article. Please use less than 20 words.",
    "4": """Please summarize the following news article in less than 20 words. Below is an example.

Example article: The bus overturned and was sent hurtling down the road for about 25 metres. The local hospital says fifteen children were among those killed. The government blamed the Tamil Tiger rebels and called it a barbaric terrorist act. It's the worst attack since a ceasefire was signed in 2002. Escalating violence has left hundreds dead since the beginning of the year. A suicide bombing in Colombo in April led to air strikes. The government says the Tigers are trying to provoke a Sinhalese backlash. Sri Lanka is already in an undeclared war. Now hopes for peace must be even further away. The Tamil Tigers have denied and condemned the attack. The ancient holy city of Anuradhapura suffered an attack allegedly by the Tamil Tigers in May 1985 in which About 250 men, women and children were gunned down at the central bus stand at the Anuradhapura town. The Tigers never denied resposibility for the attack.

Example summary: The attack happened in the early morning when the bus was packed with villagers travelling to work and school. It was hit by a mine explosion.

""",
}


def sft_rows(pairs: DataFrame, instruction: str) -> DataFrame:
    """Add the ``prompt`` and ``completion`` messages of each ``src, trg`` pair."""
    return pairs.select(
        "*", user_prompt("src", instruction).alias("prompt"), assistant_completion("trg").alias("completion")
    )


def with_system_prompt(df: DataFrame, prompt_id: str, catalog: Mapping[str, str] = SYSTEM_PROMPTS) -> DataFrame:
    """Add ``system_prompt`` by the catalog key in ``prompt_id``; an unknown key is an error."""
    rows = df.sparkSession.createDataFrame(list(catalog.items()), f"{prompt_id} string, system_prompt string")
    unknown = F.raise_error(F.concat(F.lit("unknown prompt: "), F.coalesce(prompt_id, F.lit("null")))).cast("string")
    # The catalog is written out in code: a handful of rows.
    joined = df.join(F.broadcast(rows), prompt_id, "left")
    return joined.withColumn("system_prompt", F.coalesce("system_prompt", unknown))


def summary_messages(df: DataFrame, text: str = "text", limit: int = 10_000) -> DataFrame:
    """Add ``messages``: the system prompt, then the first ``limit`` characters of the text."""
    return df.withColumn("messages", system_and_user("system_prompt", char_limit(text, limit)))
