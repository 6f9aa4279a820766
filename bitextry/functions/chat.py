"""Chat messages: ``ARRAY<STRUCT<role, content>>`` columns and their rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextry.functions.strings import as_column


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), as_column(content).alias("content"))


def user_prompt(text: Column | str, instruction: str) -> Column:
    """One user message: the instruction, a line break, the source text."""
    return F.array(message("user", F.concat(F.lit(instruction + "\n"), as_column(text))))


def assistant_completion(text: Column | str) -> Column:
    """One assistant message holding the target text."""
    return F.array(message("assistant", text))


def system_and_user(system: Column | str, user: Column | str) -> Column:
    return F.array(message("system", system), message("user", user))


@dataclass(frozen=True)
class ChatTemplate:
    """How a model wants its messages written out. Models differ, so this is the caller's choice."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    after_content: str = "\n"
    generation_suffix: str = "<|assistant|>\n"

    def render(self, messages: Column | str, add_generation_prompt: bool = True) -> Column:
        turns = F.transform(
            as_column(messages),
            lambda m: F.concat(
                F.lit(self.before_role), m["role"], F.lit(self.after_role), m["content"], F.lit(self.after_content)
            ),
        )
        text = F.array_join(turns, "")
        return F.concat(text, F.lit(self.generation_suffix)) if add_generation_prompt else text
