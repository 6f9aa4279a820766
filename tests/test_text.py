import random
import re

import pytest
from pyspark.sql import functions as F

from bitextry.functions import chat, strings, tokenizers

# Edge cases that the tables do not contain.
CASES = [
    "",
    " ",
    " edges　",
    "\x1cseparators\x1f",
    "two  spaces\tand a tab",
    "&quot;quoted&quot; &amp; &lt;tag&gt;",
    "1,000.50 and 3.14, or .5 and 5.",
    "x..5 y...6 z.,7 5.,.6 ,,8",
    "pre-2020-21 and co-op 5-",
    "a/b [c] {d} e~f `g` <h>?",
    "line separator",
    "<skipped>gone word-\nbroken end\nnext",
    "日本語 テキスト、です。",
    "a😀b",
]


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression.alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def python_13a(line):
    """The published rules, applied one by one."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(old, new)
    line = f" {line} "
    for pattern, replacement in tokenizers.MTEVAL_13A_RULES:
        line = re.sub(pattern, replacement.replace("$", "\\"), line)
    return line.split()


def test_strip_matches_python(spark):
    assert column(spark, CASES, strings.strip("x")) == [c.strip() for c in CASES]


def test_clean_output(spark):
    assert column(spark, CASES, strings.clean_output("x")) == [c.strip().replace("\n", " ") for c in CASES]


def test_lowercase(spark):
    assert column(spark, [" İA "], strings.normalize_line("x", True)) == [" İA ".strip().lower()]


def test_whitespace_tokens_match_python(spark):
    assert column(spark, CASES, tokenizers.whitespace_tokens("x")) == [c.split() for c in CASES]


def test_character_tokens(spark):
    assert column(spark, CASES, tokenizers.character_tokens("x")) == [list("".join(c.split())) for c in CASES]


def test_13a_matches_the_rules(spark):
    draw = random.Random(7)
    lines = CASES + ["".join(draw.choice("a1 .,-&;/(é") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    assert column(spark, lines, tokenizers.mteval_13a_tokens("x")) == [python_13a(c) for c in lines]


def test_alphanumeric_tokens(spark):
    want = [re.findall("[a-z0-9]+", c.lower()) for c in CASES]
    assert column(spark, CASES, tokenizers.alphanumeric_tokens("x")) == want


def test_pluggable_tokenizer_keeps_nulls_and_ids(spark):
    assert column(spark, ["ab", None], tokenizers.pluggable(lambda: list)(F.col("x"))) == [["a", "b"], None]
    to_ids = tokenizers.pluggable(lambda: lambda t: [ord(c) for c in t], "array<int>")
    assert column(spark, ["ab"], to_ids(F.col("x"))) == [[97, 98]]


def test_unknown_tokenizer():
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenizers.tokenizer("flores200")


def test_prefix_limit_slug_percent(spark):
    assert column(spark, ["a"], strings.instruction_prefix("x")) == [" a"]
    assert column(spark, ["😀😀b"], strings.char_limit("x", 2)) == ["😀😀"]
    paths = ["models/x/models_y", "runs/task/de-en/models_a", "t_t_a"]
    assert column(spark, paths, strings.run_slug("x", "t_")) == ["models_x_y".replace("models_", ""), "runs_task_de-en_a", "t_a"]
    assert column(spark, ["0.424"], strings.percent(F.col("x").cast("double"))) == ["42%"]


def test_chat_template(spark):
    template = chat.ChatTemplate("[", "] ", "\n", "[assistant] ")
    prompt = chat.user_prompt("x", "Translate:")
    assert column(spark, ["hi"], template.render(prompt)) == ["[user] Translate:\nhi\n[assistant] "]
    both = F.concat(prompt, chat.assistant_completion(F.lit("salut")))
    assert column(spark, ["hi"], template.render(both, False)) == ["[user] Translate:\nhi\n[assistant] salut\n"]


@pytest.mark.parametrize(
    "name, text, tokens",
    [
        ("zh", "我有3.5个apples,真的。don't", ["我", "有", "3.5", "个", "apples", ",", "真", "的", "。", "don't"]),
        ("zh", "全角，２", ["全", "角", "，", "２"]),
        ("zh", "", []),
        ("intl", "«Ça va?» 3,5€ x²-1", ["«", "Ça", "va", "?", "»", "3,5", "€", "x²-1"]),
        ("intl", "price:$4.20, ok…", ["price", ":", "$", "4.20", ",", "ok", "…"]),
    ],
)
def test_chinese_and_international_tokens(spark, name, text, tokens):
    row = spark.createDataFrame([(text,)], "t string").select(tokenizers.tokenizer(name)(F.col("t")).alias("k")).first()
    assert row.k == tokens
