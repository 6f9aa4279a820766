"""Queries over tokenizers, vocabularies' ids and token arrays. Arrays are shown joined by spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.functions import arrays, tokenizers
from bitextry.operators import batching, scoring, vocabulary
from bitextry.operators.numbering import with_ordinal
from bitextry.plans import views
from bitextry.plans.views import with_views
from bitextry.suite import sql
from bitextry.suite.registry import query

VOCAB_SIZE = views.VOCABULARY_SIZE


def shown(array: Column | str) -> Column:
    return F.array_join(array, " ")


def _tokens(spark: SparkSession, sf_dir: str, tokens: Column) -> DataFrame:
    cut = views.lines(spark, sf_dir).select("doc_id", "line_no", tokens.alias("t"))
    return cut.select("doc_id", "line_no", shown("t").alias("tokens"), F.size("t").cast("bigint").alias("n"))


def _tokens_sql(tokens: str) -> str:
    return with_views(
        f"select doc_id, line_no, array_to_string(t, ' ') tokens, len(t) n from (select *, {tokens} t from lines)", "lines"
    )


@query(_tokens_sql(sql.words("line")))
def tok_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.whitespace_tokens("line"))


@query(_tokens_sql(sql.tokens_13a("line")))
def tok_13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.mteval_13a_tokens("line"))


@query(_tokens_sql(r"regexp_extract_all(line, '[^\s\p{Z}]')"))
def tok_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.character_tokens("line"))


@query(_tokens_sql(sql.rewritten("line", tokenizers.INTERNATIONAL_RULES)))
def tok_intl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.international_tokens("line"))


@query(_tokens_sql(sql.rewritten("line", ((tokenizers.CHINESE, " $1 "), *tokenizers.MTEVAL_13A_RULES))))
def tok_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.chinese_tokens("line"))


def four_characters():
    """A toy subword tokenizer: pieces of four code points."""
    return lambda text: [text[i : i + 4] for i in range(0, len(text), 4)]


@query(_tokens_sql("[substring(line, i, 4) for i in range(1, length(line) + 1, 4)]"))
def tok_pluggable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, tokenizers.pluggable(four_characters)(F.col("line")))


@query(with_views("select tok token, id from vocab_top", "vocab_top"))
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vocabulary(spark, sf_dir, views.TOP_WORDS)


@query(with_views("select tok token, id from vocab", "vocab"))
def vocab_build_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vocabulary(spark, sf_dir)


@query(with_views("select doc_id, line_no, array_to_string(ids, ' ') ids from ids", "ids"))
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ids(spark, sf_dir).select("doc_id", "line_no", shown("ids").alias("ids"))


@query(with_views("select doc_id, line_no, array_to_string(ids, ' ') ids from ids", "ids"))
def encode_ids_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of vocabularies that are too large to broadcast."""
    vocab = vocabulary.prepare(views.vocabulary(spark, sf_dir), limit=0)
    return views.ids(spark, sf_dir, vocab).select("doc_id", "line_no", shown("ids").alias("ids"))


@query(with_views("select doc_id, line_no, array_to_string(ids[1:128], ' ') ids from ids", "ids"))
def truncate_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = arrays.truncate("ids", 128)
    return views.ids(spark, sf_dir).select("doc_id", "line_no", shown(cut).alias("ids"))


@query(
    with_views(
        "select doc_id, line_no, array_to_string(ids[greatest(len(ids) - 128, 0) + 1:], ' ') ids from ids", "ids"
    )
)
def truncate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = arrays.truncate("ids", 128, "left")
    return views.ids(spark, sf_dir).select("doc_id", "line_no", shown(cut).alias("ids"))


def _batched(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    numbered = with_ordinal(views.ids(spark, sf_dir), ["doc_id", "line_no"])
    return numbered.withColumn("batch_id", batching.batch_id("row_no", size))


def _batched_sql(size: int) -> str:
    return f"""select *, max(len(ids)) over (partition by batch_id) width from
               (select *, row_no // {size} batch_id from
                (select *, row_number() over (order by doc_id, line_no) - 1 row_no from ids))"""


@query(
    with_views(
        """select row_no, batch_id, width, array_to_string(ids || list_resize([]::int[], width - len(ids), 0), ' ') ids,
                  array_to_string(list_resize([]::int[], len(ids), 1) || list_resize([]::int[], width - len(ids), 0), ' ') mask
           from batched""",
        "ids",
        batched=_batched_sql(64),
    )
)
def pad_batch_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = batching.pad_to_longest(_batched(spark, sf_dir, 64), "ids", "batch_id", vocabulary.PAD_ID)
    return padded.select(
        "row_no",
        "batch_id",
        F.col("width").cast("bigint").alias("width"),
        shown("ids").alias("ids"),
        shown("attention_mask").alias("mask"),
    )


@query(
    with_views(
        """select doc_id, line_no, len(p) n, md5(array_to_string(p, ' ')) ids_md5 from
           (select *, list_resize([]::int[], greatest(4096 - len(ids), 0), 0) || ids[1:4096] p from ids)""",
        "ids",
    )
)
def pad_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = arrays.pad(arrays.truncate("ids", 4096), 4096, vocabulary.PAD_ID, "left")
    rows = views.ids(spark, sf_dir).select("doc_id", "line_no", padded.alias("p"))
    return rows.select("doc_id", "line_no", F.size("p").cast("bigint").alias("n"), F.md5(shown("p")).alias("ids_md5"))


@query(
    with_views(
        """select doc_id, line_no, array_to_string(list_resize([]::int[], greatest(256 - len(ids), 0), 0)
                  || list_resize([]::int[], len(ids), 1), ' ') mask from ids""",
        "ids",
    )
)
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = arrays.attention_mask("ids", 256, "left")
    return views.ids(spark, sf_dir).select("doc_id", "line_no", shown(mask).alias("mask"))


@query(
    with_views(
        """select conv_id, turn, array_to_string(s.ids || t.ids, ' ') input_ids,
                  array_to_string(list_resize([]::int[], len(s.ids), -100) || t.ids, ' ') labels
           from src_ids s join trg_ids t using (conv_id, turn)""",
        "chat",
        "vocab",
        src_ids=sql.encoded("chat", "conv_id, turn", "src"),
        trg_ids=sql.encoded("chat", "conv_id, turn", "trg"),
    )
)
def completion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary.prepare(views.vocabulary(spark, sf_dir))
    rows = views.chat(spark, sf_dir).select("conv_id", "turn", F.split("src", " ").alias("src"), F.split("trg", " ").alias("trg"))
    for side in ("src", "trg"):
        rows = vocabulary.encode(rows, side, vocab, ["conv_id", "turn"], ids=f"{side}_ids")
    return rows.select(
        "conv_id",
        "turn",
        shown(F.concat("src_ids", "trg_ids")).alias("input_ids"),
        shown(arrays.completion_labels("src_ids", "trg_ids")).alias("labels"),
    )


@query(
    with_views(
        """select doc_id, line_no,
                  array_to_string([case when ids[i] = 3 then -100 else ids[i] end for i in range(1, len(ids) + 1)], ' ') labels,
                  array_to_string([case when ids[i] = 3 then 0 else ids[i] end for i in range(1, len(ids) + 1)], ' ') unmasked
           from ids""",
        "ids",
    )
)
def label_unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = views.ids(spark, sf_dir).withColumn("labels", arrays.mask_pads("ids", vocabulary.FIRST_ID))
    unmasked = arrays.unmask_labels("labels", vocabulary.PAD_ID)
    return masked.select("doc_id", "line_no", shown("labels").alias("labels"), shown(unmasked).alias("unmasked"))


def damaged_ids(spark: SparkSession, sf_dir: str, vocab: vocabulary.Vocabulary | None = None) -> DataFrame:
    return views.ids(spark, sf_dir, vocab).withColumn("true_ids", F.col("ids")).withColumn("ids", views.damaged("ids"))


REPAIRED_SQL = f"[case when ids[i] < 0 or ids[i] >= {VOCAB_SIZE} then 0 else ids[i] end for i in range(1, len(ids) + 1)]"


def repaired(pad_id: int | None = vocabulary.PAD_ID) -> Column:
    return arrays.repair_ids("ids", VOCAB_SIZE, arrays.resolve_pad_id(pad_id, vocabulary.END_ID))


@query(with_views(f"select doc_id, line_no, array_to_string({REPAIRED_SQL}, ' ') ids from pred_ids", "pred_ids"))
def repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_ids(spark, sf_dir).select("doc_id", "line_no", shown(repaired()).alias("ids"))


DECODED_SQL = f"""select doc_id, lang, line_no, coalesce(string_agg(tok, ' ' order by i) filter (id > 2), '') text
    from (select doc_id, lang, line_no, unnest({REPAIRED_SQL}) rid, generate_subscripts(ids, 1) i from pred_ids)
    left join vocab on rid = id group by doc_id, lang, line_no"""


@query(with_views("select doc_id, line_no, text from decoded", "pred_ids", decoded=DECODED_SQL))
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, vocabulary.prepare(views.vocabulary(spark, sf_dir)))


@query(with_views("select doc_id, line_no, text from decoded", "pred_ids", decoded=DECODED_SQL))
def decode_ids_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, vocabulary.prepare(views.vocabulary(spark, sf_dir), limit=0))


def _decoded(spark: SparkSession, sf_dir: str, vocab: vocabulary.Vocabulary) -> DataFrame:
    rows = damaged_ids(spark, sf_dir, vocab).select("doc_id", "line_no", repaired().alias("ids"))
    text = vocabulary.decode(rows, "ids", vocab, ["doc_id", "line_no"])
    return text.select("doc_id", "line_no", "text")


@query(
    with_views(
        """select row_no, width + len(ids) generated, array_to_string(list_reverse(ids), ' ') ids from batched""",
        "ids",
        batched=_batched_sql(16),
    )
)
def cut_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts padded on the left, then a continuation (here the reversed prompt), then the cut."""
    rows = _batched(spark, sf_dir, 16).withColumn("reply", F.reverse("ids"))
    padded = batching.pad_to_longest(rows, "ids", "batch_id", vocabulary.PAD_ID, "left")
    made = padded.withColumn("made", F.concat("ids", "reply"))
    return made.select(
        "row_no",
        F.size("made").cast("bigint").alias("generated"),
        shown(arrays.cut_prompt("made", F.col("width"))).alias("ids"),
    )


@query(
    with_views(
        f"""select lang, round(avg(len(list_filter({REPAIRED_SQL}, lambda x: x <> 0))), 6) sys_len_avg
            from pred_ids group by lang""",
        "pred_ids",
    )
)
def gen_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = scoring.generated_length(
        damaged_ids(spark, sf_dir), arrays.count_non_pad(repaired(), vocabulary.PAD_ID), ["lang"]
    )
    return lengths.select("lang", F.round("sys_len_avg", 6).alias("sys_len_avg"))


@query(
    with_views(
        f"""select lang, min(list_min(ids)) pred_min, max(list_max(ids)) pred_max,
                   sum(len(list_filter(ids, lambda x: x < 0 or x >= {VOCAB_SIZE})))::bigint invalid_count
            from pred_ids group by lang""",
        "pred_ids",
    )
)
def id_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.id_health(damaged_ids(spark, sf_dir), "ids", VOCAB_SIZE, ["lang"])


@query(
    """select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int first_id,
              (list_position(list_reverse(embedding), list_max(embedding)) - 1)::int second_id from embeddings"""
)
def argmax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.array("embedding", F.reverse("embedding"))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", arrays.argmax_ids(logits).alias("ids"))
    return rows.select("vec_id", F.col("ids")[0].alias("first_id"), F.col("ids")[1].alias("second_id"))


@query(
    """select vec_id, array_to_string([round_even(x::double * 40, 0)::bigint for x in embedding], ' ') ids,
              array_to_string([round_even((x::double > 0)::int + 0.5, 0)::bigint for x in embedding], ' ') halves
       from embeddings"""
)
def rint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * 40)
    halves = F.transform("embedding", lambda x: F.when(x > 0, 1.5).otherwise(0.5))
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", shown(arrays.round_ids(scaled)).alias("ids"), shown(arrays.round_ids(halves)).alias("halves")
    )
