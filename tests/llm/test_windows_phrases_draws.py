"""Phrases, benchmark windows and importance resampling against brute force, SQL, and rows that hurt."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bitextry.llm import bytewords, decontamination, hattrie, phrases, radix, resampling, suite

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"
LONG = "one two three, four five six seven " * 6000
ITEM = "the quick brown fox jumps over the lazy dog again and again until night"
ROWS = [
    (1, "a b c. a b c! a b c", "en"),
    (2, f"Before it: {ITEM.upper()}; after it.", "en"),
    (3, f"{ITEM} {ITEM}", None),
    (4, None, "en"),
    (5, "", "de"),
    (6, " \t\n ;;; ", "de"),
    (7, LONG, "en"),
    (8, LONG, "en"),
    (9, "Íó ñ\x01Σ É 12:30, don't\x0bstop x\ty", "es"),
    (9, "Íó ñ\x01Σ É 12:30, don't\x0bstop x\ty", "es"),
    (None, "tiny item", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def crowded(docs):
    names = ("n_words", "ranges", "ITEMS", "weight", "score", "rank", "_row", "_pos", "_block", "_k0", "_digit", "_windows", "_found")
    return docs.select("*", *(F.lit(1).alias(n) for n in names))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(10, ITEM), (2, "Tiny, item"), (7, "12 30"), (8, None), (9, "--"), (11, ITEM), (None, "don")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def matches_oracle(spark, name, sf_dir=SF_DIR):
    found = suite.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.sql(suite.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(found.columns) == columns
    rows = lambda table: sorted(map(repr, (tuple(r[c] for c in columns) for r in table.to_pylist())))
    assert rows(found.toArrow()) == rows(want)
    return dict(found.dtypes)


@pytest.mark.parametrize("name", ["op11_phrases", "op12_decontamination", "op13_resampling"])
def test_queries_match_sql(spark, name):
    types = matches_oracle(spark, name)
    assert set(types.values()) <= {"bigint", "string", "boolean"}


# Words


def test_word_lists_are_whole_whatever_the_chunk():
    text = "".join(random.Random(3).choices("aZ9é\x00 -\x7f\n ß", k=5000))
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    want = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    for chunk in (1, 7, 100, 1 << 20):
        assert [w for part in bytewords.word_lists(text.encode(), chunk) for w in part] == want
    assert len(bytewords.WORD.findall(text)) == len(want)
    assert list(bytewords.word_lists(None)) == list(bytewords.word_lists(b"")) == []


# Phrases


def brute_phrases(rows, least, top, covered=50):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                best = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                inside = any(
                    f[q] >= least and 100 * f[q] >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                    for q in f
                    if len(q) > len(p)
                )
                if not inside:
                    scored.append((-best[0], -a, " ".join(p).encode(), f[p[: best[1]]], f[p[best[1] :]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("entries, vocabulary, chunk", [(1_200_000, 300_000, 1 << 20), (40, 1000, 64), (1000, 5, 16)])
def test_phrases_with_and_without_spills(spark, entries, vocabulary, chunk):
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "city", "É", "x-1", *(f"w{i}" for i in range(12))]
    rows = [
        (i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(60)), lang)
        for i, lang in zip(range(60), itertools.cycle(["en", "en", None]))
    ] + ROWS[:6]
    spec = phrases.PhraseSpec(least=3, top=50, entries=entries, vocabulary=vocabulary, chunk=chunk)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), spec)
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 3, 50)


def test_phrases_of_rows_that_hurt(docs, crowded):
    spec = phrases.PhraseSpec(least=2)
    got = sorted(tuple(r) for r in phrases.collocations(docs, spec).collect())
    assert got == brute_phrases(ROWS, 2, 2000)
    assert got == sorted(tuple(r) for r in phrases.collocations(crowded, spec).collect())
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 10**14 + 9, 3 * 10**14 + 1
    grams = spark.createDataFrame([("en", [1], left), ("en", [2], right), ("en", [1, 2], a)], "lang string, ids array<bigint>, f bigint")
    found = phrases.cuts(grams.filter(F.size("ids") > 1).withColumnRenamed("f", "a"), grams).first()
    assert found["score"] == 1_000_000 * a * a // (left * right)


def test_clashing_hashes_start_again(spark, docs, monkeypatch):
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    whole = phrases.word_hashes

    def hashes(words, seed):
        return whole(words, seed) if seed else np.arange(len(words)) % 2 + 1

    monkeypatch.setattr(phrases, "word_hashes", hashes)
    spec = phrases.PhraseSpec(least=2)
    assert phrases.counted(rows, spec, 4, 0).filter("clash").count() > 0
    assert sorted(tuple(r) for r in phrases.collocations(docs, spec).collect()) == brute_phrases(ROWS, 2, 2000)


def test_tries_count_and_give_up_subtrees():
    rng = np.random.default_rng(1)
    columns = [rng.integers(2, 300, 20_000), rng.integers(2, 9, 20_000), rng.integers(2, 2000, 20_000)]
    keys = hattrie.packed(columns)
    assert all((a == b).all() for a, b in zip(hattrie.unpacked(keys), columns, strict=True))
    trie = hattrie.HatTrie(burst=50)
    for part in np.array_split(keys, 7):
        trie.add(part)
    assert any(isinstance(child, list) for child in trie.root)
    assert trie.sizes().sum() == len(np.unique(keys))
    some, counts = trie.take([1, 2])
    more, others = trie.take(list(range(64)))
    assert trie.sizes().sum() == 0 and not set(some) & set(more)
    got = dict(zip(np.concatenate([some, more]).tolist(), np.concatenate([counts, others]).tolist(), strict=True))
    assert got == collections.Counter(keys.tolist())


# Decontamination


def brute_windows(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(item, w[i : i + min(n, len(w))]) for item, t in items for w in [words(t)] if w for i in range(len(w) - min(n, len(w)) + 1)]
    out = []
    for doc, text, _ in rows:
        have, hit, ids = words(text), set(), set()
        for item, win in windows:
            for i in range(len(have) - len(win) + 1):
                if have[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    ids |= {str(item)} - {"None"}
        out.append((doc, len(have), len(hit), sorted(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("set_pairs", [200_000, 3])
def test_windows_of_rows_that_hurt(docs, crowded, items, set_pairs):
    spec = decontamination.WindowSpec(set_pairs=set_pairs)
    want = brute_windows(ROWS, [tuple(r) for r in items.collect()])
    for table in (docs, crowded):
        found = decontamination.contamination(table, items, spec)
        rows = found.select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((tuple(r) for r in rows), key=repr) == want
    assert {"weight", "_row", "_windows"} <= set(found.columns)
    assert decontamination.contamination(docs.limit(0), items, spec).count() == 0
    clean = decontamination.contamination(docs, items.limit(0), spec)
    assert clean.filter("n_hit > 0").count() == 0 and clean.count() == len(ROWS)


def test_spans_and_documents_go(docs, items):
    found = decontamination.contamination(docs.filter("doc_id is not null"), items)
    cut = {r.doc_id: r.text for r in decontamination.without_spans(found).collect()}
    assert cut[2] == "Before it: ; after it." and cut[3] == "" and cut[9] == "Íó ñ\x01Σ É 't\x0bstop x\ty"
    assert cut[4] is None and cut[5] == "" and cut[7] == LONG
    kept = {r.doc_id for r in decontamination.without_documents(found).collect()}
    assert kept == {1, 4, 5, 6, 7, 8}


def test_window_set_verifies_words():
    pairs = pd.DataFrame([("a", 2, b"x y"), ("b", 2, b"y x"), ("a", 1, b"z")], columns=["item", "size", "window"])
    windows = decontamination.WindowSet(pairs)
    windows.maps = {size: np.ones_like(marks) for size, marks in windows.maps.items()}
    hit, found = windows.search(windows.codes(b"x x y q z y y x"))
    assert hit.tolist() == [False, True, True, False, True, False, True, True]
    assert sorted(names[0] for _, names in found) == ["a", "a", "b"]


# Resampling


def features(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(g.encode()) for g in grams]


@pytest.mark.parametrize("shortest, longest, least_words", [(1, 1, 2), (1, 3, 0), (2, 2, 1)])
def test_resampling_against_brute_force(docs, crowded, items, shortest, longest, least_words):
    spec = resampling.ResamplingSpec(shortest, longest, buckets=97, percent=40, least_words=least_words)
    raw, target = collections.Counter(), collections.Counter()
    for _, text, _ in ROWS:
        raw.update(c % 97 for c in features(text, shortest, longest)[1])
    for row in items.collect():
        target.update(c % 97 for c in features(row.text, shortest, longest)[1])
    s, t = sum(raw.values()), sum(target.values())
    rows = []
    for doc, text, _ in ROWS:
        words, found = features(text, shortest, longest)
        gain = [math.floor(1000 * math.log((target[c % 97] + 1) * (s + 97) / ((raw[c % 97] + 1) * (t + 97)))) for c in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, len(words) >= least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * 40 // 100]
    want = sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)], key=repr)
    for table in (docs, crowded):
        found = resampling.draw(resampling.weigh(table, items, spec), spec)
        got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
        assert sorted((r for r in got if r[4]), key=repr) == want
        assert sorted((r[:4] for r in got), key=repr) == sorted((r[:4] for r in rows), key=repr)
    sample = resampling.resample(crowded, items, spec)
    assert {(r.doc_id, r["rank"]) for r in sample.collect()} == {(r[0], r[4]) for r in want}
    assert {"text", "_row", "_digit"} <= set(sample.columns)


def test_resampling_of_empty_tables(docs, items):
    assert resampling.draw(resampling.weigh(docs.limit(0), items)).count() == 0
    found = resampling.weigh(docs, items.limit(0))
    assert found.count() == len(ROWS) and found.filter("weight is null").count() == 0


# Radix sort


@pytest.mark.parametrize("bits, block_rows", [(11, 1 << 18), (3, 20)])
def test_ranks_against_sorting(spark, bits, block_rows):
    rng = random.Random(9)
    ends = [-(1 << 63), (1 << 63) - 1, 0, None]
    rows = [(i, rng.choice([None, *range(-3, 3)]), rng.choice(ends)) for i in range(300)]
    frame = spark.createDataFrame(rows, "i bigint, a bigint, b bigint").repartition(5)
    found = radix.ranked(frame, [F.col("a"), F.col("b"), F.col("i")], spec=radix.RadixSpec(bits, block_rows))
    order = [r.i for r in sorted(found.collect(), key=lambda r: r["rank"])]
    key = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0, r[0])
    assert order == [r[0] for r in sorted(rows, key=key)]
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 301))


def test_ranks_of_equal_keys_and_no_rows(spark):
    frame = spark.range(50).withColumn("k", F.lit(5))
    assert sorted(r["rank"] for r in radix.ranked(frame, [F.col("k")]).collect()) == list(range(1, 51))
    assert radix.ranked(frame.limit(0), [F.col("k")]).count() == 0
    stable = radix.ranked(spark.range(40).coalesce(1), [F.col("id") % 4]).orderBy("rank").collect()
    assert [r.id for r in stable] == sorted(range(40), key=lambda i: i % 4)
