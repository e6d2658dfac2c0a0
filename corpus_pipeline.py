"""The corpus pipeline: stages that each apply one training-data operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import mixing, neardup, packing, rules, suffix
from terravane.llm.common import stash
from terravane.sources import tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the least doc_id."""
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier too are cut from the texts; n_chars follows."""
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target shares: a document is written as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and place in it."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: SQL cannot express the sampled suffixes, signatures and tokenizer of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each writes its result to the shared folder for the next.

    Once it is written, all tables of the stage itself and the result before it go.
    """
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(tables.written())
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        *used, _ = (path for path in tables.written() if path not in others)
        tables.remove(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
