"""Training-data pipeline: five stages over ``documents``, each one of the operators.

Every stage reads what the one before it kept, from a Parquet table in the
shared folder.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipwright.llm import jaccard, leaks, lines, pieces, toxicity
from clipwright.llm.queries import piece_model
from clipwright.llm.store import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; no document goes."""
    return lines.with_kept_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle overlap the one with the smallest id stays."""
    return jaccard.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, as digests."""
    return pieces.piece_digests(docs, piece_model())


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram jaccard", one_of_near_copies), ("decontamination", drop_leaks), ("sentencepiece", encode)]

#: Classifier, link closure and tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir)).df
    return docs
