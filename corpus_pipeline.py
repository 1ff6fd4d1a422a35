"""The corpus pipeline: five operators of terrapane.llm in a row, from documents to a mixing order.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame, which is written
as Parquet and read again for the next one.  All stages but the last keep the columns of documents; doc_id is the key.

Null texts have no language and go in the first stage; empty tables pass through; extra columns stay.  Rows that repeat
an id share its fate in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm import decontamination, jaccard_join, language_id, secret_scan, shared, source_mixing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no learned language explains, go."""
    return language_id.keep_identified(docs, language_id.sample(docs, "lang"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked by five-word shingles at a similarity of 0.8, the one with the least id stays."""
    found = jaccard_join.jaccard_components(docs, 5, 80)
    gone = shared.saved(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 of a benchmark item's five-word shingles go."""
    return decontamination.without_items(docs, shared.table(spark, sf_dir, "benchmark"), 5, 80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secret_scan.redact(docs, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, source_rank, block, slot, position, target_weight: the order in which the sources are interleaved."""
    return source_mixing.mix_sources(docs.withColumn("source", F.col("source").cast("string")))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
]

#: No SQL expresses a suffix automaton, a random forest or a deadline schedule; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
