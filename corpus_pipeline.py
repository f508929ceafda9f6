"""The corpus pipeline: grade, drop near duplicates, pseudonymise, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and reads them back as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.llm import gam, mixing, near_copies, pseudonyms, queries
from orthomill.llm.tables import stored, word_count


def _documents(feedback: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the columns of ``docs``; the number of characters follows the text where it is a column."""
    out = queries.as_documents(feedback)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts as good."""
    return queries.as_documents(gam.keep_good(queries.as_feedback(docs), queries.labels_of(spark, sf_dir))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles at a Jaccard similarity of 0.8 or more."""
    return queries.as_documents(near_copies.keep_first_copies(queries.as_feedback(docs))).select(docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses under pseudonyms."""
    return _documents(pseudonyms.pseudonymise_notes(queries.as_feedback(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled within output shards."""
    return queries.as_documents(mixing.mixed_notes(queries.as_feedback(docs), word_count(F.col("notes")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return queries.packed(docs)


STAGES = [("grade", grade), ("near_duplicates", near_duplicates), ("pseudonymise", pseudonymise), ("mix", mix), ("pack", pack)]

#: A trained model, fingerprints, keyed permutations and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
