"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.

Null text has no letter and goes in the first stage, empty text and text without letters too. Equal texts leave one row, ties go as the operators'
docstrings say. Rows that repeat an id or have none are rows of their own. Very long texts are taken whole and packed in pieces.
Null in other columns does no harm, other columns than those of documents stay to the last stage, and an empty table gives an empty
result. Where no row is labelled there is no profile to judge by, and all documents with a letter stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, langid, packing, scratch, simhash, suffix_dedup

#: A repeated passage has so many words; one of so many words with fewer bytes isn't prose. KGRAM is a power of two below MATCH.
PASSAGE, MATCH, KGRAM = 50, 200, 64


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by profiles learned from the labelled ones, with lang filled in where it is null; those without a letter go."""
    return langid.speaks(docs, langid.learn(langid.labelled_rows(docs)))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_distinct(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of a Jaccard of 0.8 or more."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE words or more that occur elsewhere; those of under MATCH bytes aren't looked for."""
    return suffix_dedup.without_repeats(docs, MATCH, KGRAM, least_words=PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", with_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: Fingerprints, suffix arrays and tokenizers are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
