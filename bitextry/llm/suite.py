"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.llm import (
    covertree,
    decontamination,
    fingerprints,
    forest,
    language,
    likelihood,
    mixing,
    packing,
    personal,
    phrases,
    resampling,
    sharding,
    tokencount,
)
from bitextry.llm.common import Query, table, whole_text
from bitextry.session import small

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def held_out() -> "F.Column":
    """Rows that a language model must not learn from; a row without an id is one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.fit(docs, ~held_out())
    named = language.identify(docs.select("doc_id", "text"), dictionaries)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, outcome = forest.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("_row", "doc_id").join(outcome, "_row").drop("_row")


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find(docs, personal.fit(docs))

    def joined(spans: "F.Column") -> "F.Column":
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> "F.Column":
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, personal.KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ordered = mixing.in_order(mixing.mix(docs).drop("text"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position", "takes")


def word_encoder() -> packing.WordEncoder:
    import public_tokenizers

    return packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_encoder)


def piece_measure() -> tokencount.Measure:
    import public_tokenizers

    return tokencount.piece_measure(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, piece_measure)
    n_bytes = F.octet_length(whole_text()).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole_text()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        sharding.hash_key(text).alias("group"),
    )
    placed = sharding.shard_by_size(docs, [F.col("group"), sharding.hash_key(F.col("doc_id"))], "size", 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good and not toxic, the background all other documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = (
        table(spark, sf_dir, "labels")
        .filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("target"))
    )
    marked = docs.join(small(good, good.count()), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")
    )
    return likelihood.fit_score(marked).drop("text", "target")


@query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return covertree.nearest(vectors, F.col("vec_id") % 50 == 0)


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weighed = resampling.weigh(docs, table(spark, sf_dir, "benchmark"))
    return resampling.draw(weighed.drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op9_nearest_vectors"] = """
with whole as (
    select vec_id, [floor(256 * x::double) for x in embedding] v from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
    select q.vec_id query_id, d.vec_id vec_id, list_dot_product(q.v, d.v)::bigint score
    from whole q join whole d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of ASCII letters, digits and all beyond ASCII, with A to Z in lower case.
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op11_phrases"] = rf"""
with pieces as (
    select coalesce(lang, 'und') lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) piece
    from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i
          from words, (values (1), (2), (3)) sizes(k) where len(w) >= k)
    group by all),
totals as (select lang, sum(f)::bigint n from grams where k = 1 group by lang),
candidates as (select lang, k, phrase, string_split(phrase, ' ') w, f a from grams where k > 1 and f >= 10),
cuts as (
    select c.lang, c.k, c.phrase, c.w, c.a, cut, l.f l, r.f r,
           (1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f))::bigint score
    from (select *, unnest(range(1, k)) cut from candidates) c
    join grams l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ')
    join grams r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:], ' ')),
lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_parts as (
    select lang, array_to_string(w[i:i + 1], ' ') phrase, max(a) longer
    from (select *, unnest(range(1, k)) i from candidates where k = 3) group by all),
free as (
    select s.* from lowest s left join inner_parts p on p.lang = s.lang and p.phrase = s.phrase
    where p.longer is null or 100 * p.longer < 50 * s.a),
ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLES["op12_decontamination"] = rf"""
with docs as (select row_number() over () id, doc_id, {WORDS} w from documents),
items as (select item_id, {WORDS} w from benchmark),
windows as (
    select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') win
    from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i
          from items where len(w) > 0)),
seen as (
    select id, k, i, array_to_string(w[i:i + k - 1], ' ') win
    from (select id, w, k, unnest(range(1, len(w) - k + 2)) i
          from docs, (select distinct k from windows) where len(w) >= k)),
found as (select id, k, i, item_id from seen join windows using (k, win)),
hits as (select id, count(*) n_hit from (select distinct id, unnest(range(i, i + k)) place from found) group by id),
named as (
    select id, count(*) n_items, string_agg(item, ',' order by item) names
    from (select distinct id, item_id::varchar item from found where item_id is not null) group by id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join hits using (id) left join named using (id)
"""

# CRC-32 byte by byte: eight shifts of the polynomial make the table's 256 entries.
ORACLES["op13_resampling"] = rf"""
with crc as (
    select list(c order by b) t from (
        select b, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, b) c
        from (select unnest(range(256)) b))),
docs as (select row_number() over () id, doc_id, {WORDS} w from documents),
raw_words as (select word, count(*) n from (select unnest(w) word from docs) group by word),
target_words as (select word, count(*) n from (select unnest({WORDS}) word from benchmark) group by word),
spelled as (select word, hex(encode(word)) h from (select word from raw_words union select word from target_words)),
hashed as (
    select word,
           xor(4294967295, list_reduce(
               [('0x' || substr(h, 2 * i + 1, 2))::bigint for i in range(len(h) // 2)],
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint)) % 10000 bucket
    from spelled, crc),
buckets as (
    select bucket, sum(coalesce(r.n, 0)) s, sum(coalesce(t.n, 0)) t
    from hashed left join raw_words r using (word) left join target_words t using (word) group by bucket),
sums as (select sum(s)::double sa, sum(t)::double ta from buckets),
gains as (
    select bucket, floor(1000 * ln((t::double + 1) * (sa + 10000) / ((s::double + 1) * (ta + 10000))))::bigint gain
    from buckets, sums),
weights as (
    select id, count(*) n, floor(sum(gain)::double / count(*))::bigint weight
    from (select id, unnest(w) word from docs) join hashed using (word) join gains using (bucket) group by id),
scored as (
    select id, doc_id, len(w) n_features, coalesce(weight, 0)::bigint weight,
           ('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint::double h
    from docs left join weights using (id)),
final as (
    select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from scored),
able as (
    select id, row_number() over (order by score desc, doc_id) rank, count(*) over () n
    from final where n_features >= 20)
select doc_id, n_features::bigint n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank
from final left join able using (id)
"""
