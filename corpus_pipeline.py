"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, benchmark decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Nulls, empty texts, ties, repeated rows and extra columns: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velspar.llm import decontaminate, lang_id, line_dedup, near_dup, packing
from velspar.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return lang_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document whose lines all occur in others goes with them."""
    return line_dedup.remove_repeats(spark, docs, drop_emptied=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.keep_first(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their bins."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("best_fit_packing", packed)]

#: Training of the language model, MinHash candidates verified on shingle sets and greedy packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
