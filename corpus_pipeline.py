"""A training corpus from raw documents: language, lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickvet.llm import bestfit, edit_decontam, linejoin, ppm, simhash
from tickvet.llm.common import materialize
from tickvet.llm.queries import BPE_FILE, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in one of the corpus's languages."""
    return ppm.reject_foreign(docs, ppm.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, of one word or more; n_chars follows the text."""
    from pyspark.sql import functions as F

    return linejoin.dedup_lines(docs, least_words=1).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return bestfit.pack(docs, vocabulary(BPE_FILE))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None  # trained models and tokenizers have no SQL; tests/llm compares the stages' operators with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
