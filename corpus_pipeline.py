"""Corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents.

Every stage judges row by row.  A null text and one without words are no duplicates
and no leaks; the network judges them as empty texts; they pack as their end mark.  A
null doc_id is carried along, also through packing; repeated rows are duplicates of
which one stays.  Of a group of near-duplicates the row of smallest doc_id stays, one
without doc_id only if there is no other.  Empty tables pass through all stages and
give empty results; without labels the first stage keeps everything, with labels of one
kind only all documents are of that kind.  Texts of any length are read whole.  Other columns of documents
stay as they are up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import decontaminate, packing, personal, quality, simhash
from lorewell.shared import shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The network is trained on the labelled documents of the whole table; documents it rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays."""
    return simhash.drop_near_duplicate_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.drop_leaking_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced."""
    return personal.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a pack."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained network decides; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
