"""DuckDB fragments shared by the query equivalents."""

from __future__ import annotations

import re

from bitextry.functions.draws import FIRST_FACTOR, SECOND_FACTOR
from bitextry.functions.tokenizers import MTEVAL_13A_RULES


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def words(column: str) -> str:
    """White-space tokens."""
    return rf"list_filter(regexp_split_to_array({column}, '\s+'), lambda t: t <> '')"


def tokens_13a(column: str) -> str:
    out = f"replace({column}, '<skipped>', '')"
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, {literal(old)}, {literal(new)})"
    out = f"' ' || {out} || ' '"
    for pattern, replacement in MTEVAL_13A_RULES:
        ours = replacement.replace("$", "\\")
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(ours)}, 'g')"
    return words(out)


def rewritten(column: str, rules) -> str:
    """Words of ``column`` after replacing all matches of each rule in turn."""
    out = column
    for pattern, replacement in rules:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(replacement.replace('$', chr(92)))}, 'g')"
    return words(out)


def alphanumeric(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[a-z0-9]+')"


def encoded(source: str, keys: str, text: str) -> str:
    """Ids of the space-separated words of ``text`` by the ``vocab`` view."""
    return (
        f"select {keys}, list(coalesce(id, 2) order by i) ids from "
        f"(select {keys}, unnest(string_split({text}, ' ')) tok, generate_subscripts(string_split({text}, ' '), 1) i "
        f"from {source}) t left join vocab v on t.tok = v.tok group by {keys}"
    )


NUMBERED = "select *, row_number() over (order by doc_id, line_no) - 1 row_no from lines"


def _statistics(source: str, by: str, keys: str, orders: int, grams: str, lengths: str) -> dict[str, str]:
    """Clipped matches per group and order. ``grams`` and ``lengths`` are in terms of ``x`` and ``n``."""
    every = ", ".join(f"({n})" for n in range(1, orders + 1))

    def counted(side: str) -> str:
        gram = grams.replace("$x", side)
        return (
            f"select {by}, {keys}, n, g, count(*) c from (select {by}, {keys}, n, unnest({gram}) g "
            f"from cut, (values {every}) t(n)) group by all"
        )

    hyp_n, ref_n = (f"greatest({lengths.replace('$x', side)} - n + 1, 0)" for side in ("h", "r"))
    return {
        "cut": source,
        "hyp_grams": counted("h"),
        "ref_grams": counted("r"),
        "matched": f"select {by}, n, sum(least(a.c, b.c)) m from hyp_grams a join ref_grams b using ({by}, {keys}, n, g) group by all",
        "totals": (
            f"select {by}, n, sum({hyp_n}) t, sum(case when {ref_n} > 0 then {hyp_n} else 0 end) th, sum({ref_n}) tr, "
            f"sum({lengths.replace('$x', 'h')}) hl, sum({lengths.replace('$x', 'r')}) rl "
            f"from cut, (values {every}) t(n) group by all"
        ),
        "sums": f"select {by}, n, coalesce(m, 0) m, t, th, tr, hl, rl from totals left join matched using ({by}, n)",
    }


def bleu(source: str, by: str, keys: str, smooth: str = "none", prefix: str = "") -> dict[str, str]:
    """CTEs that end in ``{prefix}bleu``: ``by, bleu, bleu_p1..4, bleu_bp, ref_len, sys_len``."""
    cut = f"select {by}, {keys}, {tokens_13a('hyp')} h, {tokens_13a('ref')} r from {source}"
    grams = "list_transform(range(1, len($x) - n + 2), lambda i: array_to_string($x[i:i + n - 1], ' '))"
    parts = _statistics(cut, by, keys, 4, grams, "len($x)")
    smoothed = "100.0 / (2 ** misses * t)" if smooth == "exp" else "0.0"
    parts["precisions"] = (
        f"select *, case when hits = 0 or t = 0 then 0.0 when m = 0 then {smoothed} else 100.0 * m / t end p from "
        f"(select *, sum(m) over (partition by {by}) hits, "
        f"sum((m = 0 and t > 0)::int) over (partition by {by} order by n) misses from sums)"
    )
    parts["bleu"] = f"""select {by},
          case when min(p) > 0 then any_value(bp) * exp(sum(ln(p)) / 4) else 0.0 end bleu,
          {', '.join(f'max(p) filter (n = {n}) bleu_p{n}' for n in range(1, 5))},
          any_value(bp) bleu_bp, any_value(rl)::bigint ref_len, any_value(hl)::bigint sys_len
        from (select *, case when hl >= rl then 1.0 when hl = 0 then 0.0 else exp(1 - rl / hl) end bp from precisions)
        group by {by}"""
    return _prefixed(parts, prefix)


def chrf(source: str, by: str, keys: str, prefix: str = "c_") -> dict[str, str]:
    """CTEs that end in ``{prefix}chrf``: ``by, chrf``."""
    h, r = (rf"regexp_replace({side}, '[\s\p{{Z}}]+', '', 'g')" for side in ("hyp", "ref"))
    cut = f"select {by}, {keys}, {h} h, {r} r from {source}"
    parts = _statistics(cut, by, keys, 6, "[substring($x, i, n) for i in range(1, length($x) - n + 2)]", "length($x)")
    parts["averages"] = (
        f"select {by}, coalesce(avg(m / th) filter (th > 0 and tr > 0), 0) p, "
        f"coalesce(avg(m / tr) filter (th > 0 and tr > 0), 0) r from sums group by {by}"
    )
    parts["chrf"] = f"select {by}, case when p + r > 0 then 100 * 5 * p * r / (4 * p + r) else 0.0 end chrf from averages"
    return _prefixed(parts, prefix)


def _prefixed(parts: dict[str, str], prefix: str) -> dict[str, str]:
    if not prefix:
        return parts
    out = {}
    for name, body in parts.items():
        for other in parts:
            body = re.sub(rf"\b(from|join) {other}\b", rf"\1 {prefix}{other}", body)
        out[prefix + name] = body
    return out


def rounded(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) {c}" for c in columns.split())


def rouge(source: str, key: str, ref: str = "summary", filler: str | None = None) -> dict[str, str]:
    """CTEs that end in ``rouge``: ``key, rouge1, rouge2, rougeL`` of ``hyp`` against ``ref``.

    With a ``filler``, every hypothesis is its reference with words left out or replaced by that word, which no
    reference has; then the longest common subsequence is the number of its other words.
    """
    cut = f"select {key}, {alphanumeric('hyp')} h, {alphanumeric(ref)} r from {source}"
    parts = {"r_cut": cut}
    for n in (1, 2):
        for side in ("h", "r"):
            parts[f"r_{side}{n}"] = (
                f"select {key}, g, count(*) c from (select {key}, unnest(list_transform(range(1, len({side}) - {n} + 2), "
                f"lambda i: array_to_string({side}[i:i + {n} - 1], ' '))) g from r_cut) group by all"
            )
        parts[f"r_m{n}"] = f"select {key}, sum(least(a.c, b.c)) m from r_h{n} a join r_r{n} b using ({key}, g) group by all"
    # One row of the subsequence table per hypothesis token.
    parts["r_lcs"] = f"""
        with recursive steps as (
          select {key}, 0 i, h, len(h) n, j, r[j] t, 0 v from (select *, unnest(range(1, len(r) + 1)) j from r_cut)
          union all
          select {key}, i + 1, h, n, j, t, max(c) over (partition by {key} order by j) v from
            (select *, greatest(v, coalesce(lag(v) over (partition by {key} order by j), 0) + (t = h[i + 1])::int) c
             from steps where i < n))
        select {key}, max(v) v from steps where i = n group by {key}"""
    if filler is not None:
        parts["r_lcs"] = f"select {key}, len([x for x in h if x <> '{filler}']) v from r_cut"

    def f1(match: str, n: int) -> str:
        both = f"(greatest(len(h) - {n} + 1, 0) + greatest(len(r) - {n} + 1, 0))"
        return f"case when {both} > 0 then 2.0 * coalesce({match}, 0) / {both} else 0.0 end"

    parts["rouge"] = f"""select {key}, {f1('a.m', 1)} rouge1, {f1('b.m', 2)} rouge2, {f1('l.v', 1)} "rougeL"
        from r_cut left join r_m1 a using ({key}) left join r_m2 b using ({key}) left join r_lcs l using ({key})"""
    return parts


def mixed(value: str, name: str) -> str:
    """Columns of a select list that end in ``name``: the 32-bit mixing of ``functions.draws`` of ``value``."""
    keep = "4294967295::ubigint"
    return f"""{value} {name}_0, (xor({name}_0, {name}_0 >> 16) * {FIRST_FACTOR}::ubigint) & {keep} {name}_1,
        (xor({name}_1, {name}_1 >> 13) * {SECOND_FACTOR}::ubigint) & {keep} {name}_2, xor({name}_2, {name}_2 >> 16) {name}"""
