"""Queries over row selection, batches and vocabulary comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.functions.draws import ROUNDS, round_keys
from bitextry.functions.tokenizers import mteval_13a_tokens
from bitextry.operators import batching, vocabulary
from bitextry.operators.numbering import with_ordinal
from bitextry.plans import views
from bitextry.plans.views import with_views
from bitextry.suite import sql
from bitextry.suite.registry import query

BATCH = 16


@query(with_views(f"select doc_id, line_no, row_no, line from ({sql.NUMBERED}) where row_no < 64", "lines"))
def head_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = batching.ordered_head(views.lines(spark, sf_dir), ["doc_id", "line_no"], 64, "row_no")
    return first.select("doc_id", "line_no", F.col("row_no").cast("bigint"), "line")


@query(
    with_views(
        f"select doc_id, line_no, row_no, row_no // 64 batch_id from ({sql.NUMBERED})",
        "lines",
    )
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = with_ordinal(views.lines(spark, sf_dir).select("doc_id", "line_no"), ["doc_id", "line_no"])
    return numbered.withColumn("batch_id", batching.batch_id("row_no", 64))


@query(
    with_views(
        f"""select doc_id, line_no, epoch, position, (position + epoch * n) // {BATCH} step from
            (select *, row_number() over (partition by epoch order by md5('42:' || key), key) - 1 as "position" from
             (select doc_id, line_no, epoch, epoch || ':' || doc_id || ':' || line_no key, count(*) over (partition by epoch) n
              from lines, (values (0), (1)) e(epoch)))
            where position + epoch * n < {BATCH} * ceil(1.5 * n / {BATCH})""",
        "lines",
    )
)
def seeded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One and a half epochs of shuffled batches."""
    rows = views.lines(spark, sf_dir).select("doc_id", "line_no")
    steps = math.ceil(1.5 * rows.count() / BATCH)
    made = batching.seeded_batches(rows, F.concat_ws(":", "doc_id", "line_no"), BATCH, steps)
    return made.select("doc_id", "line_no", "epoch", "position", "step")


def _permutation_sql() -> str:
    """Positions of ``seeded_permutation``: rounds of the network, walked on until they are below the number of rows."""
    rounds = ", ".join(
        f"""{sql.mixed(f"xor(r{i}, k{i})", f"f{i}")}, xor(l{i}, f{i} & m) r{i + 1}, r{i} l{i + 1}""" for i in range(ROUNDS)
    )
    step = f"""select doc_id, line_no, epoch, n, h, m, {", ".join(f"k{i}" for i in range(ROUNDS))}, (l{ROUNDS} << h) | r{ROUNDS} x
               from (select *, x >> h l0, x & m r0, {rounds} from {{}})"""
    epochs = ", ".join(f"({e}, {', '.join(f'{k}::ubigint' for k in round_keys(42, e))})" for e in (0, 1))
    views_sql = with_views(
        "",
        "lines",
        numbered=f"select doc_id, line_no, row_no, count(*) over () n from ({sql.NUMBERED})",
        first=f"""select *, ((1::ubigint << h) - 1)::ubigint m, row_no::ubigint x from
                  (select *, greatest(1, (length(bin(n - 1)) + 1) // 2)::ubigint h from numbered)
                  cross join (values {epochs}) e(epoch, {", ".join(f"k{i}" for i in range(ROUNDS))})""",
    ).rstrip()
    return f"""{views_sql.replace("with ", "with recursive ", 1)}, walk as
        ({step.format("first")} union all {step.format("(select * from walk where x >= n)")})
        select doc_id, line_no, epoch, x::bigint as "position", (x::bigint + epoch * n) // {BATCH} step from walk
        where x < n and x::bigint + epoch * n < {BATCH} * ceil(1.5 * n / {BATCH})"""


@query(_permutation_sql())
def seeded_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One and a half epochs of batches in the order of keyed permutations."""
    rows = with_ordinal(views.lines(spark, sf_dir).select("doc_id", "line_no"), ["doc_id", "line_no"])
    count = rows.count()
    made = batching.permuted_batches(rows, BATCH, math.ceil(1.5 * count / BATCH), line_no="row_no", rows=count)
    return made.select("doc_id", "line_no", "epoch", "position", "step")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = (mteval_13a_tokens(side) for side in ("ref", "hyp"))
    return vocabulary.pair_types(views.pairs(spark, sf_dir), ref, hyp, ["lang"])


TOKENS_SQL = f"""select lang, 'ref' side, unnest({sql.tokens_13a('ref')}) token from pairs
    union all select lang, 'hyp', unnest({sql.tokens_13a('hyp')}) from pairs"""
COUNTS_SQL = "select lang, side, token, count(*) n from toks group by all"


def _compared(body: str) -> str:
    return with_views(body, "pairs", toks=TOKENS_SQL, counts=COUNTS_SQL)


@query(_compared("select lang, side, token, n from counts"))
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = (mteval_13a_tokens(side) for side in ("ref", "hyp"))
    tokens = vocabulary.side_tokens(views.pairs(spark, sf_dir), ref, hyp, ["lang"])
    return vocabulary.token_counts(tokens, ["lang"])


TOP_SQL = """select lang, side, rank::int rank, token, n from
    (select *, row_number() over (partition by lang, side order by n desc, token) rank from counts) where rank <= 20"""


@query(_compared(TOP_SQL))
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.top_tokens(_types(spark, sf_dir), 20, ["lang"]).select("lang", "side", "rank", "token", "n")


@query(
    _compared(
        """select lang, side, rank::int rank, token from
           (select *, row_number() over (partition by lang, side order by token) rank from counts c
            where not exists (select 1 from counts o where o.lang = c.lang and o.token = c.token and o.side <> c.side))
           where rank <= 7"""
    )
)
def exclusive_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.exclusive_examples(_types(spark, sf_dir), 7, ["lang"])


OVERLAP_SQL = """select lang, ref_types, hyp_types, both_types, ref_only_types, hyp_only_types,
      both_types / ref_types both_share, ref_only_types / ref_types ref_only_share, hyp_only_types / hyp_types hyp_only_share
    from (select lang, count(*) filter (r) ref_types, count(*) filter (h) hyp_types, count(*) filter (r and h) both_types,
                 count(*) filter (r and not h) ref_only_types, count(*) filter (h and not r) hyp_only_types
          from (select lang, token, bool_or(side = 'ref') r, bool_or(side = 'hyp') h from counts group by all) group by lang)"""


@query(
    with_views(
        """select lang, ref_types, hyp_types, both_types, ref_only_types, hyp_only_types, round(both_share, 6) both_share,
                  round(ref_only_share, 6) ref_only_share, round(hyp_only_share, 6) hyp_only_share from overlap""",
        "pairs",
        toks=TOKENS_SQL,
        counts=COUNTS_SQL,
        overlap=OVERLAP_SQL,
    )
)
def type_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = vocabulary.overlap_report(_types(spark, sf_dir), ["lang"])
    shares = ["both_share", "ref_only_share", "hyp_only_share"]
    return report.withColumns({s: F.round(s, 6) for s in shares})


def _side_types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = views.pairs(spark, sf_dir)
    ref, hyp = (pairs.select(F.explode(mteval_13a_tokens(s)).alias("token")).distinct() for s in ("ref", "hyp"))
    return ref, hyp


def _types_of(side: str) -> str:
    return f"select distinct token from toks where side = '{side}'"


def _sets(body: str) -> str:
    return with_views(body, "pairs", toks=TOKENS_SQL)


@query(_sets("select distinct side, token from toks"))
def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = _side_types(spark, sf_dir)
    return ref.select(F.lit("ref").alias("side"), "token").union(hyp.select(F.lit("hyp").alias("side"), "token"))


@query(_sets(f"{_types_of('ref')} and token in ({_types_of('hyp')})"))
def shared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.shared_types(*_side_types(spark, sf_dir))


@query(
    _sets(
        f"""select 'ref' side, token from ({_types_of('ref')}) where token not in ({_types_of('hyp')})
            union all select 'hyp', token from ({_types_of('hyp')}) where token not in ({_types_of('ref')})"""
    )
)
def exclusive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = _side_types(spark, sf_dir)
    ref_only, hyp_only = vocabulary.types_only_in(ref, hyp), vocabulary.types_only_in(hyp, ref)
    return ref_only.select(F.lit("ref").alias("side"), "token").union(hyp_only.select(F.lit("hyp").alias("side"), "token"))


@query(_sets(f"{_types_of('ref')} intersect {_types_of('hyp')}"))
def types_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = _side_types(spark, sf_dir)
    return ref.intersect(hyp)


@query(_sets(f"{_types_of('ref')} except {_types_of('hyp')}"))
def types_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = _side_types(spark, sf_dir)
    return ref.subtract(hyp)
