"""Corpus metrics as partial aggregations: row statistics, native sums, then a closed form.

Any number of metrics share one pass. Grouping by language, source or step is an ordinary ``by``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from bitextry.functions import kernels
from bitextry.functions.shifts import ShiftLimits
from bitextry.functions.strings import as_column
from bitextry.functions.tokenizers import Tokenizer, alphanumeric_tokens, mteval_13a_tokens, tokenizer

ROUGE_TYPES = ("rouge1", "rouge2", "rougeL")


@dataclass(frozen=True)
class Bleu:
    """Corpus BLEU (Papineni et al. 2002; conventions of Post 2018). ``smooth`` is ``none`` or ``exp``."""

    smooth: str = "none"
    tokenize: str | Tokenizer = "13a"
    lowercase: bool = False
    name: str = "bleu"
    fields: Sequence[str] = field(default=tuple(kernels.BLEU_FIELDS), repr=False)
    greater_is_better: ClassVar[bool] = True

    def signature(self, references: int | str = 1) -> str:
        """What the score depends on besides the texts."""
        cut = self.tokenize if isinstance(self.tokenize, str) else getattr(self.tokenize, "__name__", "custom")
        return f"nrefs:{references}|case:{'lc' if self.lowercase else 'mixed'}|eff:no|tok:{cut}|smooth:{self.smooth}"

    def statistics(self, hyp: Column, refs: Column) -> Column:
        cut = tokenizer(self.tokenize)
        case = F.lower if self.lowercase else (lambda x: x)
        if cut is mteval_13a_tokens:
            return kernels.bleu_text_statistics(case(hyp), F.transform(refs, case), cut)
        return kernels.bleu_statistics(cut(case(hyp)), F.transform(refs, lambda r: cut(case(r))))

    def scores(self, total: Callable[[str], Column]) -> dict[str, Column]:
        if self.smooth not in ("none", "exp"):
            raise ValueError(f"unknown smoothing {self.smooth!r}")
        orders = range(1, kernels.BLEU_ORDER + 1)
        match = {n: total(f"match_{n}") for n in orders}
        tokens = {n: total(f"total_{n}") for n in orders}
        sys_len, ref_len = total("sys_len"), total("ref_len")
        any_match = sum((match[n] for n in orders), F.lit(0)) > 0
        precision = {}
        misses = F.lit(0)
        for n in orders:
            plain = F.try_divide(match[n] * 100.0, tokens[n])
            if self.smooth == "exp":
                missed = (match[n] == 0) & (tokens[n] > 0)
                misses = misses + F.when(missed, 1).otherwise(0)
                plain = F.when(missed, F.lit(100.0) / (F.pow(F.lit(2.0), misses) * tokens[n])).otherwise(plain)
            precision[n] = F.when(any_match, F.coalesce(plain, F.lit(0.0))).otherwise(0.0)
        penalty = (
            F.when(sys_len >= ref_len, 1.0)
            .when(sys_len == 0, 0.0)
            .otherwise(F.exp(F.lit(1.0) - ref_len / sys_len))
        )
        logs = sum((F.ln(precision[n]) for n in orders), F.lit(0.0)) / kernels.BLEU_ORDER
        positive = F.least(*precision.values()) > 0
        return {
            self.name: F.when(positive, penalty * F.exp(logs)).otherwise(0.0),
            **{f"{self.name}_p{n}": precision[n] for n in orders},
            f"{self.name}_bp": penalty,
            "ref_len": ref_len,
            "sys_len": sys_len,
        }


@dataclass(frozen=True)
class Chrf:
    """Corpus chrF (Popovic 2015): character n-grams up to order 6, beta 2."""

    lowercase: bool = False
    beta: float = 2.0
    name: str = "chrf"
    fields: Sequence[str] = field(default=tuple(kernels.CHRF_FIELDS), repr=False)
    greater_is_better: ClassVar[bool] = True

    def signature(self, references: int | str = 1) -> str:
        """What the score depends on besides the texts."""
        case, beta = "lc" if self.lowercase else "mixed", "" if self.beta == 2 else f"|beta:{self.beta:g}"
        return f"nrefs:{references}|case:{case}|eff:yes|nc:{kernels.CHRF_ORDER}|nw:0|space:no{beta}"

    def statistics(self, hyp: Column, refs: Column) -> Column:
        case = F.lower if self.lowercase else (lambda x: x)

        return kernels.chrf_statistics(case(hyp), F.transform(refs, case))

    def scores(self, total: Callable[[str], Column]) -> dict[str, Column]:
        zero = F.lit(0.0)
        precision, recall, orders = zero, zero, zero
        for n in range(1, kernels.CHRF_ORDER + 1):
            match, hyp, ref = (total(f"{kind}_{n}") for kind in ("match", "hyp", "ref"))
            both = (hyp > 0) & (ref > 0)
            precision = precision + F.when(both, match / hyp).otherwise(zero)
            recall = recall + F.when(both, match / ref).otherwise(zero)
            orders = orders + F.when(both, 1.0).otherwise(zero)
        precision, recall = F.try_divide(precision, orders), F.try_divide(recall, orders)
        weight = self.beta**2
        score = F.try_divide(precision * recall * (100.0 * (1 + weight)), precision * weight + recall)
        return {self.name: F.coalesce(score, zero)}


@dataclass(frozen=True)
class Ter:
    """Corpus TER (Snover et al. 2006). ``shifts=False`` leaves plain word edits."""

    case_sensitive: bool = False
    shifts: bool = True
    limits: ShiftLimits = ShiftLimits()
    name: str = "ter"
    fields: Sequence[str] = field(default=("edits", "ref_words"), repr=False)
    greater_is_better: ClassVar[bool] = False

    def signature(self, references: int | str = 1) -> str:
        """What the score depends on besides the texts."""
        case, shifts = "mixed" if self.case_sensitive else "lc", "yes" if self.shifts else "no"
        limits = "" if self.limits == ShiftLimits() or not self.shifts else f"|limits:{self.limits}"
        return f"nrefs:{references}|case:{case}|tok:none|shifts:{shifts}{limits}"

    def statistics(self, hyp: Column, refs: Column) -> Column:
        case = (lambda x: x) if self.case_sensitive else F.lower
        texts = case(hyp), F.transform(refs, case)
        return kernels.ter_statistics(*texts, self.limits) if self.shifts else kernels.word_edit_statistics(*texts)

    def scores(self, total: Callable[[str], Column]) -> dict[str, Column]:
        edits, words = total("edits"), total("ref_words")
        empty = F.when(edits > 0, 100.0).otherwise(0.0)
        return {
            self.name: F.when(words > 0, edits * 100.0 / words).otherwise(empty),
            f"{self.name}_edits": edits,
            f"{self.name}_ref_words": words,
        }


METRICS: dict[str, Callable[..., Bleu | Chrf | Ter]] = {
    "bleu": Bleu,
    "sacrebleu": lambda **kw: Bleu(smooth="exp", **kw),
    "chrf": Chrf,
    "ter": Ter,
    "word_edit_rate": lambda **kw: Ter(shifts=False, name="word_edit_rate", **kw),
}


def metric(name: str, **options) -> Bleu | Chrf | Ter:
    """A metric from the registry, by name."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name](**options)


def _references(df: DataFrame, ref: str | Column) -> Column:
    """References as an array; a plain string column is wrapped."""
    column = as_column(ref)
    return column if isinstance(df.select(column).schema[0].dataType, ArrayType) else F.array(column)


def row_statistics(df: DataFrame, metrics: Sequence, hyp: str | Column = "hyp", ref: str | Column = "ref", by: Sequence[str] = ()) -> DataFrame:
    """``by..., <metric>__<field>...``: the additive statistics of every row."""
    refs = _references(df, ref)
    stats = df.select(*by, *(m.statistics(as_column(hyp), refs).alias(f"_{m.name}") for m in metrics))
    return stats.select(
        *by, *(F.col(f"_{m.name}")[f].alias(f"{m.name}__{f}") for m in metrics for f in m.fields)
    )


def sum_statistics(stats: DataFrame, metrics: Sequence, by: Sequence[str] = ()) -> DataFrame:
    names = [f"{m.name}__{f}" for m in metrics for f in m.fields]
    return stats.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))


def close_scores(sums: DataFrame, metrics: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Scores from summed statistics; an empty corpus counts as zeros."""
    columns: dict[str, Column] = {}
    for m in metrics:

        def total(name: str, m=m) -> Column:
            return F.coalesce(F.col(f"{m.name}__{name}"), F.lit(0))

        columns.update(m.scores(total))
    return sums.select(*by, *(c.alias(n) for n, c in columns.items()))


def corpus_scores(df: DataFrame, metrics: Sequence, hyp: str | Column = "hyp", ref: str | Column = "ref", by: Sequence[str] = ()) -> DataFrame:
    """One row of scores per ``by`` group (one row in all without ``by``)."""
    stats = row_statistics(df, metrics, hyp, ref, by)
    return close_scores(sum_statistics(stats, metrics, by), metrics, by)


def rouge_scores(df: DataFrame, hyp: str | Column = "hyp", ref: str | Column = "ref") -> DataFrame:
    """Add ``rouge1``, ``rouge2`` and ``rougeL`` F-measures (Lin 2004) to every row.

    Tokens are ASCII letters and digits, so a text in another script has none and scores 0.
    """
    stats = kernels.rouge_statistics(alphanumeric_tokens(hyp), alphanumeric_tokens(ref))
    with_stats = df.withColumn("_rouge", stats)
    s = F.col("_rouge")

    def f_measure(match: Column, hyp_total: Column, ref_total: Column) -> Column:
        return F.coalesce(F.try_divide(match * 2.0, hyp_total + ref_total), F.lit(0.0))

    return with_stats.select(
        *df.columns,
        f_measure(s["match_1"], s["hyp_1"], s["ref_1"]).alias("rouge1"),
        f_measure(s["match_2"], s["hyp_2"], s["ref_2"]).alias("rouge2"),
        f_measure(s["lcs"], s["hyp_1"], s["ref_1"]).alias("rougeL"),
    )


def generated_length(df: DataFrame, non_pad: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(non_pad).alias("sys_len_avg"))


HEALTH_COLUMNS = ("_id_min", "_id_max", "_id_invalid")


def health_columns(ids: str, vocab_size: int) -> dict[str, Column]:
    """Per row: the smallest and largest id, and how many lie outside the vocabulary."""
    invalid = F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocab_size)))
    return dict(zip(HEALTH_COLUMNS, (F.array_min(ids), F.array_max(ids), invalid)))


def health_aggregates() -> dict[str, Column]:
    """Aggregates over :func:`health_columns`; the extremes of no ids at all are null."""
    return {
        "pred_min": F.min("_id_min"),
        "pred_max": F.max("_id_max"),
        "invalid_count": F.coalesce(F.sum("_id_invalid"), F.lit(0)),
    }


def id_health(df: DataFrame, ids: str, vocab_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest predicted id and how many are invalid."""
    rows = df.withColumns(health_columns(ids, vocab_size))
    return rows.groupBy(*by).agg(*(c.alias(n) for n, c in health_aggregates().items()))
