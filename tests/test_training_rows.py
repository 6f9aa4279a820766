"""Training rows look both sides up at once, and only the tokens that stay."""

import pytest
from pyspark.sql import functions as F

from bitextry.operators import vocabulary
from bitextry.operators.vocabulary import END_ID, UNKNOWN_ID, build_vocabulary, prepare
from bitextry.plans import jobs


@pytest.mark.parametrize("limit", [vocabulary.BROADCAST_BYTES, 20, 0])
def test_rows_move_once_with_the_kept_columns_only(spark, limit, monkeypatch):
    rows = [(1, "a b c d e", "b a", "x"), (2, None, "c", "y"), (3, "zz a", None, "z"), (4, "", "", "w"), (5, "a", "e d c b a a", "v")]
    pairs = spark.createDataFrame(rows, "k int, src string, trg string, other string").repartition(3)
    vocab = prepare(build_vocabulary(pairs.select(F.explode(F.split("trg", " ")).alias("token")).filter("token <> ''")), limit)
    ids = {r.token: r.id for r in vocab.frame.collect()}
    looked = []
    encode = vocabulary.encode

    def watched(df, tokens, *rest):
        looked.append((df.columns, df.agg(F.max(F.size(tokens))).first()[0]))
        return encode(df, tokens, *rest)

    monkeypatch.setattr(vocabulary, "encode", watched)
    made = jobs.seq2seq_rows(pairs, vocab, ["k"], "p", max_length=4, keep=[])
    assert made.columns == ["k", "input_ids", "labels", "attention_mask"]

    def coded(text):
        return [ids.get(w, UNKNOWN_ID) for w in (text or "").split()][:3] + [END_ID]

    found = {r.k: (r.input_ids, r.labels, r.attention_mask) for r in made.collect()}
    want = {}
    for k, src, trg, _ in rows:
        source = coded(None if src is None else f"p {src}")
        want[k] = (source, coded(trg), [1] * len(source))
    assert found == want
    # One lookup, without texts, of at most three tokens of each side.
    [(columns, most)] = looked
    assert not {"src", "trg", "other"} & set(columns) and most == 5
    monkeypatch.undo()
    assert jobs.seq2seq_rows(pairs, vocab, ["k"], "p").columns == [*pairs.columns, "input_ids", "labels", "attention_mask"]
