"""A corpus pipeline of five stages; each takes documents and returns documents, the last one token counts and hashes.

quality_rules drops rejected documents, near_dedup keeps one of each group (five-word shingles, similarity 0.8),
secret_scan replaces secrets by a mark, mixing repeats and drops documents to the sources' target weights, and
byte_bpe encodes what is left and decodes it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm import bpe, mixing, near_dups, quality, secrets
from loamgraph.llm.common import checkpoint_dir, table
from loamgraph.llm.queries import MULTI_RANKS, PIECES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, MULTI_RANKS, PIECES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, width=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, MULTI_RANKS)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix_sources), ("byte_bpe", byte_bpe)]

#: Forests, chosen paths and tokenisers have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
