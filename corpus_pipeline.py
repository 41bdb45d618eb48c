"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark
decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as
Parquet in the shared folder and reads it again as the next one's documents.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolevec.llm.decontaminate import remove_contamination
from rolevec.llm.langid import keep_identified
from rolevec.llm.linededup import dedup_lines
from rolevec.llm.ngram_join import keep_one
from rolevec.llm.packing import pack_documents
from rolevec.session import scratch_path, staging

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that repeat an earlier one, up to two edits, are cut out."""
    return dedup_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id."""
    return keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document with nothing left goes."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: A trained model and a tokenizer take part, so SQL can't express it; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with staging(spark):  # a stage leaves nothing behind but its output
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
