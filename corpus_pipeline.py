"""A corpus pipeline of the operators in ``bitextry.llm``: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextry.llm import forest, language, mixing, packing, personal
from bitextry.llm.common import table
from bitextry.llm.suite import word_encoder
from bitextry.session import checkpointed

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with that language in ``lang``. Learns from the labelled rows."""
    dictionaries = language.fit(docs, F.lit(True))
    named = language.identify(docs, dictionaries)
    return named.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word shingles are similar: the one with the smallest doc_id."""
    rows, outcome = forest.similar_documents(docs)
    return rows.join(outcome.filter("kept").select("_row"), "_row").select(*DOCUMENT_COLUMNS)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of data in brackets in the place of personal data."""
    masked = personal.redacted(docs, personal.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document for each time that the mix takes it; one that is taken in part has its first words only."""
    rows = mixing.training_rows(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all takes with their token ids, and their places in sequences of 2048 tokens."""
    return packing.pack(docs, word_encoder, ids=True)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal", personal_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# No stage can be written in SQL: compression, MinHash, a recurrent network and a linear program decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
