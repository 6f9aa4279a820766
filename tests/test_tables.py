import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitextry.functions import arrays
from bitextry.functions.draws import permute, round_keys
from bitextry.functions.tokenizers import pluggable
from bitextry.operators import batching, checkpoints, vocabulary
from bitextry.operators.align import align, pair_steps_with_references
from bitextry.operators.inference import predict
from bitextry.operators.numbering import following, running, shuffled_ordinal, with_ordinal
from bitextry.operators.prompts import SYSTEM_PROMPTS, with_system_prompt


def test_with_ordinal_is_the_global_order(spark):
    values = [(i * 7919) % 1000 for i in range(1000)]
    rows = spark.createDataFrame([(v, -v) for v in values], "a int, b int").repartition(13)
    got = with_ordinal(rows, ["b"]).collect()
    assert sorted((r["row_no"], r["a"]) for r in got) == [(i, 999 - i) for i in range(1000)]


def test_shuffled_ordinal_is_a_seeded_permutation(spark):
    rows = spark.range(2000)
    first, again, other = (
        {r["id"]: r["row_no"] for r in shuffled_ordinal(df, F.col("id").cast("string"), seed).collect()}
        for df, seed in ((rows, 1), (rows.repartition(9), 1), (rows, 2))
    )
    assert sorted(first.values()) == list(range(2000)) and first == again and first != other
    kept = shuffled_ordinal(rows, F.col("id").cast("string"), 1, keep=F.lit(300)).collect()
    assert {r["id"]: r["row_no"] for r in kept} == {k: v for k, v in first.items() if v < 300}


def test_seeded_batches_repeat_and_cap(spark):
    rows = spark.range(10).withColumn("k", F.col("id").cast("string"))
    got = batching.seeded_batches(rows, F.col("k"), 4, 6).collect()
    assert len(got) == 24 and {r["step"] for r in got} == set(range(6))
    for step in range(6):
        assert sum(r["step"] == step for r in got) == 4
    for epoch in (0, 1):
        assert sorted(r["id"] for r in got if r["epoch"] == epoch) == list(range(10))
    orders = [[r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["epoch"] == e] for e in (0, 1)]
    assert orders[0] != orders[1]


def test_permutations_are_bijections_of_any_size():
    for size in (1, 2, 3, 5, 16, 17, 1000, 4097):
        orders = [permute(np.arange(size), size, round_keys(7, epoch)) for epoch in (0, 1)]
        assert all(sorted(order) == list(range(size)) for order in orders)
        assert size < 16 or (orders[0] != orders[1]).any()
    # Numbers beyond 32 bits stay in range and apart.
    size = 10**13 + 7
    some = permute(np.arange(size - 5000, size), size, round_keys(7, 0))
    assert some.min() >= 0 and some.max() < size and len(set(some)) == 5000
    # No trace of the old order.
    order = permute(np.arange(4096), 4096, round_keys(7, 0))
    assert abs(np.corrcoef(np.arange(4096), order)[0, 1]) < 0.1


def test_permuted_batches_repeat_and_cap(spark):
    rows = spark.range(10).withColumnRenamed("id", "line_no")
    got = batching.permuted_batches(rows, 4, 6).collect()
    assert sorted((r["epoch"], r["position"]) for r in got) == [(e, p) for e in range(3) for p in range(10)][:24]
    for step in range(6):
        assert sum(r["step"] == step for r in got) == 4
    for epoch in (0, 1):
        assert sorted(r["line_no"] for r in got if r["epoch"] == epoch) == list(range(10))
    again = batching.permuted_batches(rows.repartition(5), 4, 6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(ValueError, match="no rows"):
        batching.permuted_batches(rows.limit(0), 4, 6)
    with pytest.raises(Exception, match="numbered from 0 to 4"):
        batching.permuted_batches(rows, 4, 6, rows=5).collect()


def test_permuted_batches_do_not_shuffle(spark):
    made = batching.permuted_batches(spark.range(100).withColumnRenamed("id", "line_no"), 4, 6, rows=100)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_running_with_one_hot_key(spark):
    draw = random.Random(1)
    rows = [(1 if i % 3 else i, i, draw.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, step int, v double").repartition(7)
    got = running(
        df,
        ["k"],
        "step",
        F.floor(F.col("step") / 50),
        {
            "n": ("count", F.lit(1), True),
            "total": ("sum", F.col("v"), False),
            "low": ("min", F.col("v"), False),
            "top": ("max", F.col("v"), True),
        },
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [v for k, s, v in rows if k == r["k"] and s < r["step"]]
        assert r["n"] == len(before) + 1
        assert r["total"] == pytest.approx(sum(before))
        assert r["low"] == (min(before) if before else None)
        assert r["top"] == max([*before, r["v"]])


def test_following_crosses_chunks(spark):
    rows = [(k, t, f"{k}-{t}") for k in (1, 2) for t in range(0, 60, 1 + k)]
    got = following(spark.createDataFrame(rows, "k int, t int, x string"), ["k"], "t", F.floor(F.col("t") / 7), ["x"])
    for r in got.collect():
        later = f"{r['k']}-{r['t'] + 1 + r['k']}"
        assert r["next_x"] == (later if r["t"] + 1 + r["k"] < 60 else None)


def test_align_is_strict(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "line_no int, src string")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "line_no int, trg string")
    assert [tuple(r) for r in align(left, right, ["line_no"]).orderBy("line_no").collect()] == [(0, "a", "x"), (1, "b", "y")]
    for a, b in ((left, right.limit(1)), (left.limit(1), right)):
        with pytest.raises(Exception, match="no partner"):
            align(a, b, ["line_no"]).collect()
        with pytest.raises(Exception, match="no partner"):
            align(a, b, ["line_no"]).count()


@pytest.mark.parametrize(
    "lines",
    [
        [(5, 0), (5, 1), (5, 2)],  # one too many
        [(5, 0)],  # one too few
        [(5, 0), (5, 0)],  # one twice and one too few
        [(5, 0), (5, 1), (6, 0)],  # another step too short
        [(5, 0), (5, 7)],  # one without a reference
    ],
)
def test_every_step_needs_every_reference_once(spark, lines):
    refs = spark.createDataFrame([(0, "a"), (1, "b")], "line_no bigint, ref string")
    steps = spark.createDataFrame([(s, n, "h") for s, n in lines], "step int, line_no bigint, hyp string")
    with pytest.raises(Exception, match="reference|twice"):
        pair_steps_with_references(steps, refs).collect()
    whole = spark.createDataFrame([(s, n, "h") for s in (5, 6) for n in (0, 1)], "step int, line_no bigint, hyp string")
    assert pair_steps_with_references(whole, refs).count() == 4


def test_align_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(0, "a"), (0, "b")], "line_no bigint, hyp string")
    right = spark.createDataFrame([(0, "r")], "line_no bigint, ref string")
    with pytest.raises(Exception, match="twice"):
        align(left, right, ["line_no"]).collect()


def test_running_and_following_keep_null_keys_and_orders(spark):
    rows = [(None, 1, 5.0), (None, 2, 4.0), ("a", None, 3.0), ("a", 7, 2.0)]
    log = spark.createDataFrame(rows, "run string, step int, v double")
    summed = running(log, ["run"], "step", F.floor(F.col("step") / 2), {"n": ("count", F.lit(1), True)})
    assert sorted((str(r.run), r.n) for r in summed.collect()) == [("None", 1), ("None", 2), ("a", 1), ("a", 2)]
    nexts = following(log, ["run"], "step", F.floor(F.col("step") / 2), ["v"])
    assert sorted((r.v, r.next_v) for r in nexts.collect() if r.next_v) == [(3.0, 2.0), (5.0, 4.0)] and nexts.count() == 4


def test_runs_without_values_stay(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 1, 2.0)], "run string, step int, eval_loss double")
    found = {r.run: (r.best_step, r.best_value) for r in checkpoints.best_checkpoint(log).collect()}
    assert found == {"a": (None, None), "b": (1, 2.0)}
    counted = {r.run: r.improved for r in checkpoints.patience_counter(log).collect()}
    assert counted == {"a": True, "b": True}


def test_models_and_tokenizers_load_once_per_worker(spark, tmp_path):
    """More tasks than workers: each process makes the model once."""
    folder = str(tmp_path)

    def model():
        open(f"{folder}/model-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda values: [str(v) for v in values]

    def cutter():
        open(f"{folder}/cutter-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [t.split() for t in texts]

    rows = spark.range(0, 400, 1, 40).select(F.col("id").cast("string").alias("t"))
    predict(rows, model, "t", "out").write.format("noop").mode("overwrite").save()
    cut = pluggable(cutter, batched=True)
    assert rows.select(cut(F.col("t")).alias("k")).filter("size(k) = 1").count() == 400
    for kind in ("model", "cutter"):
        made = [name.split("-")[1] for name in os.listdir(folder) if name.startswith(kind)]
        assert made and len(made) == len(set(made))


def test_unknown_prompt(spark):
    rows = spark.createDataFrame([("1",), ("9",)], "prompt_id string")
    known = with_system_prompt(rows.filter("prompt_id = '1'"), "prompt_id").first()
    assert known["system_prompt"] == SYSTEM_PROMPTS["1"]
    with pytest.raises(Exception, match="unknown prompt: 9"):
        with_system_prompt(rows, "prompt_id").collect()


def test_head_needs_enough_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "line_no")
    assert sorted(r["line_no"] for r in batching.head(rows, 4).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="only 10"):
        batching.head(rows, 64)


def ids_frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, ids array<int>")


def only(df, expression):
    return [r["y"] for r in sorted(df.select("i", expression.alias("y")).collect(), key=lambda r: r["i"])]


def test_array_functions(spark):
    df = ids_frame(spark, [[1, 2, 3, 4], [5], []])
    assert only(df, arrays.truncate("ids", 2)) == [[1, 2], [5], []]
    assert only(df, arrays.truncate("ids", 2, "left")) == [[3, 4], [5], []]
    assert only(df, arrays.pad("ids", 3, 0, "left")) == [[1, 2, 3, 4], [0, 0, 5], [0, 0, 0]]
    assert only(df, arrays.attention_mask("ids", 3, "left")) == [[1, 1, 1, 1], [0, 0, 1], [0, 0, 0]]
    assert only(df, arrays.repair_ids("ids", 4, 0)) == [[1, 2, 3, 0], [0], []]
    assert only(df, arrays.completion_labels("ids", F.array(F.lit(9)))) == [[-100] * 4 + [9], [-100, 9], [9]]
    assert only(df, arrays.unmask_labels(arrays.mask_pads("ids", 2), 2)) == [[1, 2, 3, 4], [5], []]
    assert only(df, arrays.count_non_pad("ids", 5)) == [4, 0, 0]
    assert (arrays.resolve_pad_id(None, 7), arrays.resolve_pad_id(None, None), arrays.resolve_pad_id(0, 7)) == (7, 0, 0)
    with pytest.raises(ValueError):
        arrays.truncate("ids", 2, "middle")


def test_pad_then_cut_round_trip(spark):
    df = ids_frame(spark, [[1, 2, 3], [4], [5, 6]]).withColumn("batch", F.floor(F.col("i") / 2))
    padded = batching.pad_to_longest(df, "ids", "batch", 0, "left")
    made = F.concat("ids", F.array(F.lit(8), F.lit(9)))
    assert only(padded, arrays.cut_prompt(made, F.col("width"))) == [[8, 9]] * 3
    assert only(padded, F.col("attention_mask")) == [[1, 1, 1], [0, 0, 1], [1, 1]]


def test_argmax_and_rounding(spark):
    df = spark.createDataFrame([(0, [[1.0, 3.0, 3.0], [2.0, 2.0, 1.0]])], "i int, l array<array<double>>")
    assert only(df, arrays.argmax_ids("l")) == [[1, 0]]
    halves = spark.createDataFrame([(0, [0.5, 1.5, 2.5, -0.5])], "i int, x array<double>")
    assert only(halves, arrays.round_ids("x")) == [[0, 2, 2, 0]]


def test_vocabulary_paths_agree(spark):
    draw = random.Random(2)
    words = [f"w{min(int(draw.expovariate(0.2)), 40)}" for _ in range(3000)]
    lines = [(i, words[i * 10 : i * 10 + draw.randint(0, 10)]) for i in range(300)]
    df = spark.createDataFrame(lines, "k int, tokens array<string>")
    tokens = df.select(F.explode("tokens").alias("token"))
    vocab = vocabulary.build_vocabulary(tokens, 20)
    whole = vocabulary.build_vocabulary(tokens)
    assert {tuple(r) for r in vocab.collect()} <= {tuple(r) for r in whole.collect()}
    assert sorted(r["id"] for r in whole.collect()) == list(range(3, 3 + whole.count()))
    looked_up = vocabulary.encode(df, "tokens", vocab, ["k"])
    as_table = vocabulary.prepare(vocab, limit=5)
    assert as_table.tokens is None and vocabulary.prepare(vocab, limit=2000).tokens is not None
    joined = vocabulary.encode(df, "tokens", as_table, ["k"])
    assert sorted(looked_up.collect()) == sorted(joined.collect())
    back = vocabulary.decode(looked_up, "ids", vocab, ["k"])
    again = vocabulary.decode(looked_up, "ids", as_table, ["k"])
    assert sorted(back.collect()) == sorted(again.collect())
    known = {r["token"] for r in vocab.collect()}
    want = {k: " ".join(t for t in ts if t in known) for k, ts in lines}
    assert {r["k"]: r["text"] for r in back.collect()} == want


def test_type_report(spark):
    pairs = spark.createDataFrame([("a b a", "a c"), ("d", "d e")], "ref string, hyp string")
    types = vocabulary.pair_types(pairs, F.split("ref", " "), F.split("hyp", " "))
    got = vocabulary.overlap_report(types).first()
    assert (got["ref_types"], got["hyp_types"], got["both_types"]) == (3, 4, 2)
    assert (got["ref_only_types"], got["hyp_only_types"]) == (1, 2)
    top = [tuple(r) for r in vocabulary.top_tokens(types, 2).select("side", "rank", "token", "n").orderBy("side", "rank").collect()]
    assert top == [("hyp", 1, "a", 1), ("hyp", 2, "c", 1), ("ref", 1, "a", 2), ("ref", 2, "b", 1)]
    only_one = [tuple(r) for r in vocabulary.exclusive_examples(types).orderBy("side", "rank").collect()]
    assert only_one == [("hyp", 1, "c"), ("hyp", 2, "e"), ("ref", 1, "b")]
    empty = vocabulary.overlap_report(types.filter("false")).first()
    assert empty["ref_types"] == 0 and empty["both_share"] is None


@pytest.mark.parametrize("chunk_steps", [4, 10_000])
@pytest.mark.parametrize("greater", [False, True])
def test_patience_against_a_loop(spark, greater, chunk_steps):
    draw = random.Random(6)
    log = [(run, step * 500, draw.random()) for run in ("a", "b") for step in range(1, 80)]
    df = spark.createDataFrame(log, "run string, step int, eval_loss double").repartition(5)
    chunk = F.floor(F.col("step") / (500 * chunk_steps))
    counted = checkpoints.patience_counter(df, threshold=0.05, greater_is_better=greater, chunk=chunk)
    got = {(r["run"], r["step"]): r["counter"] for r in counted.collect()}
    stops = {}
    for run in ("a", "b"):
        best, counter = None, 0
        for _, step, value in (x for x in log if x[0] == run):
            gain = None if best is None else (value - best if greater else best - value)
            counter = 0 if gain is None or gain > 0.05 else counter + 1
            best = value if gain is None or gain > 0 else best
            assert got[run, step] == counter
            if counter >= 9:
                stops.setdefault(run, step)
    found = {r["run"]: r["stop_step"] for r in checkpoints.early_stop_step(counted, 9).collect()}
    assert found == {run: stops.get(run) for run in ("a", "b")}


def test_best_checkpoint_takes_the_first_on_ties(spark):
    log = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.0), ("a", 1, 2.0), ("b", 1, None)], "run string, step int, eval_loss double")
    assert [tuple(r) for r in checkpoints.best_checkpoint(log).collect()] == [("a", 2, 1.0), ("b", None, None)]
    assert checkpoints.best_checkpoint(log, greater_is_better=True).first()["best_step"] == 1


def test_predict_batches_and_checks_length(spark):
    rows = spark.range(100).withColumn("x", F.col("id").cast("string"))

    def sizes():
        return lambda batch: [f"{len(batch) <= 7}:{x}" for x in batch]

    got = predict(rows, sizes, "x", "y", batch_size=7).collect()
    assert all(r["y"] == f"True:{r['x']}" for r in got) and len(got) == 100
    with pytest.raises(Exception, match="one output per input"):
        predict(rows, lambda: lambda batch: batch[1:], "x", "y").collect()


def test_scores_from_ids_floats_and_logits_agree(spark):
    from bitextry.plans import jobs

    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(3, 13)], "token string, id int")
    rows = [(k, [3 + (k + i) % 10 for i in range(6)], [3 + (k + i) % 9 for i in range(6)] + [-100]) for k in range(8)]
    ids = spark.createDataFrame(rows, "k int, ids array<int>, labels array<int>")
    floats = ids.withColumn("ids", F.transform("ids", lambda x: x - F.lit(0.3).cast("double")))
    one_hot = F.transform("ids", lambda x: F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: (i == x).cast("float")))
    scores = [
        jobs.score_ids(df, vocab, ["k"], 13).collect() for df in (ids, floats, ids.withColumn("ids", one_hot))
    ]
    assert scores[0] == scores[1] == scores[2] and scores[0][0]["bleu"] > 0
