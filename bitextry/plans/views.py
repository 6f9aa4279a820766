"""Corpus views over the test tables, as DataFrames and as DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.operators.numbering import following, running
from bitextry.operators.vocabulary import Vocabulary, build_vocabulary, encode, prepare
from bitextry.session import spread

TOP_WORDS = 2000
# Ids of the vocabulary stay below this, whatever the tables; the planted id is above.
VOCABULARY_SIZE = 1_000_000_000
PLANTED_ID = 1_000_000_008
STEPS = (500, 1000, 1500)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, line_no, line``: one row per document line."""
    docs = documents(spark, sf_dir)
    split = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line_no", F.col("line_no").cast("bigint"))


def degraded(line: Column) -> Column:
    """A made-up hypothesis: the line without every 7th word and with some words replaced."""
    words = F.filter(
        F.transform(
            F.split(line, " "),
            lambda w, i: F.when(i % 7 == 2, F.lit(None)).when(i % 11 == 5, F.lit("zzz")).otherwise(w),
        ),
        lambda w: w.isNotNull(),
    )
    return F.array_join(words, " ")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, line_no, hyp, ref``."""
    return lines(spark, sf_dir).select("doc_id", "lang", "line_no", degraded(F.col("line")).alias("hyp"), F.col("line").alias("ref"))


def predicted(line: Column, step: Column) -> Column:
    """A made-up prediction at an evaluation step: the line without some words, fewer of them at later steps."""
    gap = F.lit(4) + F.floor(step / 500).cast("int")
    return F.array_join(F.filter(F.split(line, " "), lambda w, i: i % gap != 2), " ")


def step_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, line_no, step, hyp, ref``: three evaluation steps of growing quality."""
    stepped = lines(spark, sf_dir).withColumn("step", F.explode(F.array(*(F.lit(s) for s in STEPS))))
    hyp = predicted(F.col("line"), F.col("step"))
    return stepped.select("doc_id", "lang", "line_no", "step", hyp.alias("hyp"), F.col("line").alias("ref"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, src, trg``: user turns with the assistant turn that follows."""
    turns = table(spark, sf_dir, "conversations")
    nexts = following(turns, ["conv_id"], "turn", F.floor(F.col("turn") / 1000), ["role", "text"])
    answered = nexts.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return answered.select("conv_id", "turn", F.col("text").alias("src"), F.col("next_text").alias("trg"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, step, eval_loss``: the events of each user as the evaluations of a run."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    placed = events.withColumn("_at", F.struct("ts", "event_id"))
    numbered = running(
        placed, ["user_id"], "_at", F.date_trunc("day", "ts"), {"step": ("count", F.lit(1), True)}
    )
    return numbered.select(F.col("user_id").alias("run"), F.col("step").cast("int"), F.col("value").alias("eval_loss"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, summary, hyp``: the first line as summary, the first 19 words as hypothesis."""
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")
    return documents(spark, sf_dir).select(
        "doc_id", "text", F.split("text", "\n")[0].alias("summary"), F.array_join(F.slice(words, 1, 19), " ").alias("hyp")
    )


def vocabulary(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """``token, id``: all reference words, or the ``size`` most frequent ones."""
    words = lines(spark, sf_dir).select(F.explode(F.split("line", " ")).alias("token"))
    return build_vocabulary(words, size)


def ids(spark: SparkSession, sf_dir: str, vocab: Vocabulary | None = None) -> DataFrame:
    """``doc_id, lang, line_no, ids``: the encoded reference lines."""
    words = lines(spark, sf_dir).select("doc_id", "lang", "line_no", F.split("line", " ").alias("tokens"))
    return encode(words, "tokens", vocab or prepare(vocabulary(spark, sf_dir)), ["doc_id", "line_no"])


def damaged(ids: Column | str) -> Column:
    """Ids with invalid ones planted: -1 at every 13th, one above all others at every 17th position."""
    return F.transform(ids, lambda x, i: F.when(i % 13 == 0, F.lit(-1)).when(i % 17 == 0, F.lit(PLANTED_ID)).otherwise(x))


# The same views for DuckDB, in order of dependence. ``materialized`` ones are used more than once.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """select doc_id, lang, (i-1)::bigint line_no, parts[i] line
           from (select doc_id, lang, string_split(text, chr(10)) parts,
                        unnest(range(1, len(string_split(text, chr(10)))+1)) i from documents)""",
    ),
    "pairs": (
        ("lines",),
        """select doc_id, lang, line_no,
             array_to_string([case when (i-1)%11=5 then 'zzz' else w[i] end
                              for i in range(1,len(w)+1) if (i-1)%7<>2],' ') hyp, line ref
           from (select *, string_split(line,' ') w from lines)""",
    ),
    "step_pairs": (
        ("lines",),
        """select doc_id, lang, line_no, st::int step,
             array_to_string([w[i] for i in range(1,len(w)+1) if (i-1) % (4 + st//500) <> 2],' ') hyp, line ref
           from (select *, string_split(line,' ') w, unnest([500,1000,1500]) st from lines)""",
    ),
    "chat": (
        (),
        """select conv_id, turn, text src, nt trg from (
             select *, lead(text) over(partition by conv_id order by turn) nt,
                       lead(role) over(partition by conv_id order by turn) nr from conversations)
           where role='user' and nr='assistant'""",
    ),
    "metric_log": (
        (),
        """select user_id run, cast(row_number() over(partition by user_id order by ts, event_id) as int) step,
                  value eval_loss from events""",
    ),
    "summ": (
        (),
        """select doc_id, text, string_split(text,chr(10))[1] summary,
                  array_to_string(string_split(replace(text,chr(10),' '),' ')[1:19],' ') hyp from documents""",
    ),
    "vocab": (
        ("lines",),
        """select tok, (row_number() over(order by n desc, tok) + 2)::int id
           from (select tok, count(*) n from (select unnest(string_split(line,' ')) tok from lines)
                 group by tok)""",
    ),
    "vocab_top": (("vocab",), f"select * from vocab order by id limit {TOP_WORDS}"),
    "ids": (
        ("lines", "vocab"),
        """select doc_id, lang, line_no, any_value(ref) ref, list(coalesce(id,2) order by i) ids
           from (select doc_id, lang, line_no, line ref, unnest(string_split(line,' ')) tok,
                        generate_subscripts(string_split(line,' '),1) i from lines) t
           left join vocab v on t.tok=v.tok group by doc_id, lang, line_no""",
    ),
    "pred_ids": (
        ("ids",),
        f"""select doc_id, lang, line_no, ref, ids true_ids,
                  [case when (i-1)%13=0 then -1 when (i-1)%17=0 then {PLANTED_ID} else ids[i] end
                   for i in range(1,len(ids)+1)] ids from ids""",
    ),
}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """``sql`` under a WITH clause that defines the named views, what they need, then ``extra`` ones."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as materialized ({SQL_VIEWS[n][1]})" for n in wanted]
    parts += [f"{n} as materialized ({body})" for n, body in extra.items()]
    return f"with {', '.join(parts)} {sql}" if parts else sql
