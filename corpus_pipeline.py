"""The corpus pipeline: five stages, each applied to all that the one before kept.

Toxic documents go; of each class of near copies the document with the least id
stays; documents that hold a benchmark passage go; sources are mixed to their
target weights, documents taken more than once repeating; the mix is put into
shards of near-equal size. Every stage but the last returns the columns of
`documents`; a stage's result is written as Parquet and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.decontaminate import without_contaminated
from larkspur.llm.durable import shared_path
from larkspur.llm.minhash import without_near_copies
from larkspur.llm.mixing import mixed_documents
from larkspur.llm.sharding import sharded_documents
from larkspur.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Trained scores and signatures have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
