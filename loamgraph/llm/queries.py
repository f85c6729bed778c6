"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_dups, negatives, quality, runs, secrets, simhash, substrings, topk, url_filter
from .bpe import encode_decode
from .common import table
from .repair import read_shards, shard_folder, write_shards
from .token_counts import token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), MULTI_RANKS, PIECES)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_folder(spark)
    write_shards(table(spark, sf_dir, "documents"), BYTE_BPE, out)
    return read_shards(spark, out)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), MULTI_RANKS)


#: host, path, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS t(host, path, verdict)")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


_ALL = (
    op1_token_counts, op2_cover_tree_top_k, op3_quality_rules, op4_mixing, op5_repair_shards, op6_secrets, op7_substring_dedup, op8_near_duplicates, op9_byte_bpe, op10_url_filter,
    op11_simhash_groups, op12_hard_negatives, op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op2_cover_tree_top_k": topk.ORACLE, "op4_mixing": mixing.ORACLE, "op7_substring_dedup": substrings.ORACLE, "op8_near_duplicates": near_dups.ORACLE, "op10_url_filter": url_filter.ORACLE, "op12_hard_negatives": negatives.ORACLE}
