"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, neardup, ordering, packing, ppm, quality, rules, sharding, suffix, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.digests(table(spark, sf_dir, "documents"))


def mixing_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op1, in shards so small that every source has many."""
    return mixing.mix(table(spark, sf_dir, "documents"), block_words=16, shard_words=2048)


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9, with a limit so small that buckets split to several depths."""
    return sharding.shard(table(spark, sf_dir, "documents"), limit=1 << 16)


def topk_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8, in blocks so small that most pairs of blocks fall under the bound."""
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.pmod("vec_id", F.lit(50)) == 0, query_block=4, block=64)


def order_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10, in shards so small that there are many."""
    return ordering.digests(table(spark, sf_dir, "documents"), shard_bytes=1 << 16)


def queries() -> dict:
    ten = (op1_mixing, op2_minhash, op3_quality, op4_rules, op5_suffix, op6_packing, op7_ppm, op8_topk, op9_sharding, op10_order)
    return {f.__name__: f for f in (*ten, mixing_small_shards, sharding_small_limit, topk_small_blocks, order_small_shards)}
