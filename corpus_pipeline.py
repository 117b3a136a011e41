"""From raw documents to packed training sequences, in five stages.

Each stage reads all that the one before it kept, and is written as Parquet before the next one
starts, so a lost executor costs the running stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import materialise, table
from docweave.llm.decontaminate import clean_documents
from docweave.llm.language import fit_profiles, keep_languages
from docweave.llm.packing import pack
from docweave.llm.quality import fit_quality, keep_quality
from docweave.llm.simhash import simhash_dedup

#: A document's n-grams must fit the profile of its language this well; a text of letters that form no words of it does not.
LEAST_FIT = 0.2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text ranks above the threshold learned from the preference labels."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones of this input teach."""
    return keep_languages(docs, fit_profiles(docs), LEAST_FIT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of least id."""
    return simhash_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for every piece of every document, with its ids and its place."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL has no classifier, no XXH64 and no tokenizer; a test holds every stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
