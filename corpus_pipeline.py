"""From raw documents to packed sequences: five operators of stratlens.llm in a row.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
one's docs. All but the last return the columns of documents. Stages work with any further columns
of docs, with repeated rows, null ids and null or empty texts as the operators' docstrings say.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlens.llm import language, minhash, packing, rules, shared, suffixes


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, however unsure; a text that is null or has no letter goes, and each text if nothing was learned."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.accepted(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels of these documents."""
    return rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (similarity 0.80 or more), the one with the smallest id."""
    return minhash.deduplicated(docs, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a repeated string of more than 50 words covers; n_chars follows the text."""
    return suffixes.without_repeats(docs, words=suffixes.WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("best-fit packing", pack),
]

# Fitted machines, learned rules and hashed sets have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), "stage")
    return docs
