"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens. Each stage is written and read again.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clipledger.llm import mixing, near, pieces, quality, secret_scan
from clipledger.llm.queries import PIECE_MODEL
from clipledger.llm.support import table
from clipledger.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row."""
    return pieces.tokens(docs, pieces.load(spark, PIECE_MODEL))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", piece_stage),
]

#: Order MinHash, entropy windows and merge-dropout are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read by the next."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (_, step) in enumerate(STAGES):
        out = f"{base}/{at}"
        step(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
