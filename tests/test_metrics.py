import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextry.functions import kernels
from bitextry.functions.draws import counter_draws
from bitextry.functions.shifts import ShiftLimits, translation_edits
from bitextry.operators import scoring
from bitextry.operators.bootstrap import bootstrap_interval, bootstrap_replicates
from bitextry.operators.scoring import Bleu, Chrf, Ter, corpus_scores
from bitextry.plans import jobs


def scored(spark, pairs, *metrics, schema="hyp string, ref string"):
    return corpus_scores(spark.createDataFrame(pairs, schema), list(metrics)).first().asDict()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def plain_bleu(rows, smooth="none"):
    """BLEU by the textbook; rows of (hypothesis tokens, list of reference tokens)."""
    match, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, refs in rows:
        sys_len += len(hyp)
        ref_len += min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
        for n in range(1, 5):
            allowed = Counter()
            for r in refs:
                allowed |= grams(r, n)
            match[n - 1] += sum((grams(hyp, n) & allowed).values())
            total[n - 1] += max(len(hyp) - n + 1, 0)
    precisions, misses = [], 0
    for m, t in zip(match, total):
        if m == 0 and t and smooth == "exp":
            misses += 1
            precisions.append(100 / (2**misses * t))
        else:
            precisions.append(100 * m / t if t else 0.0)
    penalty = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len) if sys_len else 0.0
    if not any(match) or min(precisions) == 0:
        return 0.0
    return penalty * math.exp(sum(map(math.log, precisions)) / 4)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_chrf(rows):
    total = [[0, 0, 0] for _ in range(6)]
    for hyp, ref in rows:
        hyp, ref = "".join(hyp.split()), "".join(ref.split())
        for n in range(1, 7):
            h, r = grams(hyp, n), grams(ref, n)
            total[n - 1][0] += sum((h & r).values())
            total[n - 1][1] += sum(h.values()) if r else 0
            total[n - 1][2] += sum(r.values())
    used = [(m / h, m / r) for m, h, r in total if h and r]
    if not used:
        return 0.0
    p, r = (sum(x) / len(used) for x in zip(*used))
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def sentences(seed, rows, words="abcdefgh", longest=15):
    draw = random.Random(seed)
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, longest))) for _ in range(rows)]


def test_identical_text_is_perfect(spark):
    pairs = [("the cat sat on the mat .", "the cat sat on the mat ."), ("über 5 Äpfel, ja", "über 5 Äpfel, ja")]
    got = scored(spark, pairs, Bleu(), Chrf(), Ter())
    assert got["bleu"] == pytest.approx(100) and got["chrf"] == pytest.approx(100) and got["ter"] == 0


def test_bleu_by_hand(spark):
    # 5 of 6 unigrams, 3 of 5 bigrams, 1 of 4 trigrams, 0 of 3 four-grams.
    pair = [("the cat is on the mat", "the cat sat on the mat")]
    none = scored(spark, pair, Bleu(tokenize="none"))
    assert [none[f"bleu_p{n}"] for n in range(1, 5)] == pytest.approx([500 / 6, 60, 25, 0])
    assert none["bleu"] == 0 and none["bleu_bp"] == 1 and none["ref_len"] == none["sys_len"] == 6
    exp = scored(spark, pair, Bleu(smooth="exp", tokenize="none"))
    assert exp["bleu_p4"] == pytest.approx(100 / 6)
    assert exp["bleu"] == pytest.approx(math.exp(sum(map(math.log, [500 / 6, 60, 25, 100 / 6])) / 4))


def test_bleu_brevity_and_empty(spark):
    short = scored(spark, [("a b c d", "a b c d e f")], Bleu(tokenize="none"))
    assert short["bleu_bp"] == pytest.approx(math.exp(1 - 6 / 4)) and short["bleu"] == pytest.approx(100 * math.exp(-0.5))
    empty = scored(spark, [("", "a b c")], Bleu(tokenize="none"))
    assert empty["bleu"] == 0 and empty["bleu_bp"] == 0
    nothing = scored(spark, [("x y", "a b")], Bleu(smooth="exp", tokenize="none"))
    assert nothing["bleu"] == 0
    no_rows = scored(spark, [], Bleu(), Chrf(), Ter())
    assert (no_rows["bleu"], no_rows["chrf"], no_rows["ter"]) == (0, 0, 0)


@pytest.mark.parametrize("smooth", ["none", "exp"])
def test_bleu_multiple_references(spark, smooth):
    draw = random.Random(3)
    hyps = sentences(1, 60)
    refs = [sentences(100 + i, draw.randint(1, 3)) for i in range(60)]
    got = scored(spark, list(zip(hyps, refs)), Bleu(smooth, "none"), schema="hyp string, ref array<string>")
    want = plain_bleu([(h.split(), [r.split() for r in rs]) for h, rs in zip(hyps, refs)], smooth)
    assert got["bleu"] == pytest.approx(want)


def test_bleu_lowercase_option(spark):
    pair = [("The CAT sat down now", "the cat SAT down now")]
    assert scored(spark, pair, Bleu(lowercase=True))["bleu"] == pytest.approx(100)
    assert scored(spark, pair, Bleu())["bleu"] < 100


def test_chrf_against_brute_force(spark):
    rows = list(zip(sentences(5, 200, ["aé", "bc", "d", "日本", "😀x"]), sentences(6, 200, ["aé", "bc", "d", "日本", "😀x"])))
    rows += [("", "abc"), ("abc", ""), ("ab", "abcdefgh"), ("abcdefgh", "ab")]
    assert scored(spark, rows, Chrf())["chrf"] == pytest.approx(plain_chrf(rows))


def test_chrf_keeps_the_best_reference(spark):
    row = [("hello there", ["nothing alike", "hello there"])]
    assert scored(spark, row, Chrf(), schema="hyp string, ref array<string>")["chrf"] == pytest.approx(100)


def test_slices_do_not_change_statistics(monkeypatch):
    import pyarrow as pa

    hyp = pa.array([s.split() for s in sentences(11, 300)])
    ref = pa.array([[s.split()] for s in sentences(12, 300)])
    whole = kernels.bleu_batch(hyp, ref)
    monkeypatch.setattr(kernels, "TOKENS_PER_SLICE", 7)
    assert kernels.bleu_batch(hyp, ref).equals(whole)


def test_partitioning_does_not_change_scores(spark):
    rows = spark.createDataFrame(list(zip(sentences(8, 500), sentences(9, 500))), "hyp string, ref string")
    metrics = [Bleu(), Chrf(), Ter()]
    one, many = (corpus_scores(rows.repartition(n), metrics).first() for n in (1, 37))
    assert one == many


def test_word_edits_and_lcs_against_brute_force():
    draw = random.Random(4)
    for _ in range(400):
        a, b = ([draw.randint(0, 6) for _ in range(draw.randint(0, 90))] for _ in "ab")
        assert kernels.word_edits(a, b) == plain_edits(a, b)
        assert kernels.lcs_length(a, b) == plain_lcs(a, b)


def test_ter_counts_a_moved_block_once():
    ref = "a b c d e f g h".split()
    assert translation_edits("e f g a b c d h".split(), ref) == 1
    assert plain_edits("e f g a b c d h".split(), ref) > 1
    assert translation_edits([], ref) == 8 and translation_edits(ref, []) == 8


def test_ter_known_example():
    # "THIS WEEK" moves as a block; "SAUDI", "ARABIA" and "AMERICAN" are word edits.
    ref = "SAUDI ARABIA denied THIS WEEK information published in the AMERICAN new york times".split()
    hyp = "THIS WEEK the saudis denied information published in the new york times".split()
    assert translation_edits(hyp, ref) == 4


def test_ter_never_exceeds_word_edits():
    draw = random.Random(5)
    for _ in range(150):
        ref = [draw.randint(0, 12) for _ in range(draw.randint(1, 40))]
        cut = draw.randint(0, len(ref))
        hyp = [w for w in ref[cut:] + ref[:cut] if draw.random() > 0.1]
        shifted, plain = translation_edits(hyp, ref), plain_edits(hyp, ref)
        assert shifted <= plain
        assert translation_edits(hyp, ref, ShiftLimits(tried=1)) <= plain


def test_shifts_scored_from_windows_equal_whole_distances():
    """Each round of the search against one that computes every shifted hypothesis in full."""
    draw = random.Random(9)
    for _ in range(120):
        ref = [draw.randint(0, 9) for _ in range(draw.randint(1, 24))]
        at, end = sorted(draw.sample(range(len(ref) + 1), 2))
        rest = ref[:at] + ref[end:]
        to = draw.randint(0, len(rest))
        hyp = rest[:to] + ref[at:end] + rest[to:]
        edits = translation_edits(hyp, ref)
        # Moving the block back is one shift; the greedy search needs no more edits than plain editing.
        assert edits <= plain_edits(hyp, ref) and (edits == 0) == (hyp == ref)


def test_a_cap_on_shifts_changes_long_rows():
    ref = list(range(100))
    hyp = [x for i in range(0, 100, 8) for x in reversed(ref[i : i + 8])]
    assert translation_edits(hyp, ref) < translation_edits(hyp, ref, ShiftLimits(tried=1000))


def test_ter_case_and_references(spark):
    pair = [("The cat", "the cat")]
    assert scored(spark, pair, Ter())["ter"] == 0
    assert scored(spark, pair, Ter(case_sensitive=True))["ter"] == 50
    two = scored(spark, [("a b c", ["a b c d e", "a b c"])], Ter(), schema="hyp string, ref array<string>")
    assert two["ter_edits"] == 0 and two["ter_ref_words"] == 4
    assert scored(spark, [("a b", "")], Ter())["ter"] == 100


def test_word_edit_rate_by_group_against_brute_force(spark):
    rows = [(i % 3, h, r) for i, (h, r) in enumerate(zip(sentences(21, 200), sentences(22, 200)))]
    edits = Ter(shifts=False, case_sensitive=True, name="w")
    got = corpus_scores(spark.createDataFrame(rows, "g int, hyp string, ref string"), [edits], by=["g"]).collect()
    for r in got:
        mine = [(h.split(), x.split()) for g, h, x in rows if g == r["g"]]
        total, words = sum(plain_edits(h, x) for h, x in mine), sum(len(x) for _, x in mine)
        assert r["w"] == pytest.approx(100 * total / words)


def test_rouge_by_hand(spark):
    rows = spark.createDataFrame(
        [(1, "The cat sat", "the cat lay down"), (2, "日本語", "日本語"), (3, "", "x")], "i int, hyp string, ref string"
    )
    got = {r["i"]: r for r in scoring.rouge_scores(rows).collect()}
    assert got[1]["rouge1"] == pytest.approx(4 / 7) and got[1]["rouge2"] == pytest.approx(2 / 5)
    assert got[1]["rougeL"] == pytest.approx(4 / 7)
    assert got[2]["rouge1"] == 0 and got[3]["rougeL"] == 0


def test_translation_edits_of_a_long_row_need_little_memory():
    draw = random.Random(8)
    ref = [draw.randrange(10**6) for _ in range(24_000)]
    hyp = ref[:5000] + ref[5008:5020] + ref[5000:5008] + ref[5020:20_000] + [-1] + ref[20_001:]
    tracemalloc.start()
    edits = translation_edits(hyp, ref)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edits == 2 and peak < 40e6


def test_registry():
    assert scoring.metric("sacrebleu").smooth == "exp" and scoring.metric("word_edit_rate").shifts is False
    with pytest.raises(ValueError, match="unknown metric"):
        scoring.metric("comet")


def test_bootstrap_interval_covers_the_mean(spark):
    rows = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "k int, s double")
    draws = bootstrap_replicates(rows, ["s"], F.col("k"), 200)
    assert draws.count() == 200
    got = bootstrap_interval(draws, ["s"]).first()
    assert got["s_low"] < 4.5 < got["s_high"] and got["s_low"] < got["s_mid"] < got["s_high"]
    assert got["s_high"] - got["s_low"] < 1.2
    again = bootstrap_interval(bootstrap_replicates(rows.repartition(13), ["s"], F.col("k"), 200), ["s"]).first()
    assert tuple(got) == pytest.approx(tuple(again))


def test_counter_draws_are_even_and_independent():
    first, second = (np.random.default_rng(i).integers(0, 2**32, 300) for i in (1, 2))
    drawn = counter_draws(first, second, 400).astype(np.float64) / 2**32
    assert drawn.shape == (300, 400) and abs(drawn.mean() - 0.5) < 0.005 and abs(drawn.var() - 1 / 12) < 0.002
    assert np.abs(np.corrcoef(drawn) - np.eye(300)).max() < 0.3 and np.abs(np.corrcoef(drawn.T) - np.eye(400)).max() < 0.35
    assert (counter_draws(first, second, 10) == counter_draws(first, second, 400)[:, :10]).all()


def test_signatures_name_the_settings():
    assert scoring.Bleu(lowercase=True, tokenize="zh").signature(2) == "nrefs:2|case:lc|eff:no|tok:zh|smooth:none"
    assert scoring.Chrf(beta=3).signature("var") == "nrefs:var|case:mixed|eff:yes|nc:6|nw:0|space:no|beta:3"
    assert scoring.Ter(shifts=False, case_sensitive=True).signature() == "nrefs:1|case:mixed|tok:none|shifts:no"


def test_signed_scores_of_a_whole_table(spark):
    pairs = spark.createDataFrame([("a b c d", "a b c d")], "hyp string, ref string")
    got = {r["metric"]: (round(r["value"], 6), r["signature"]) for r in jobs.signed_scores(pairs, [scoring.Bleu(), scoring.Ter()]).collect()}
    assert got == {"bleu": (100.0, scoring.Bleu().signature()), "ter": (0.0, scoring.Ter().signature())}
