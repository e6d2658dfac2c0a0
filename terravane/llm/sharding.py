"""Sharding by extendible hashing: a directory over hash-prefix bits whose oversized buckets alone split on another bit.

Only DataFrame functions are used. Edge cases: a null text has 0 bytes; a null doc_id hashes as a text of its own; a bucket
that holds one hash value only (a document above the limit, or rows repeated under one doc_id) cannot split and stays
whole; an empty table gives no rows. Other columns of the input do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, stash

BITS = 60


def shard(docs: DataFrame, limit: int = 64 << 20, seed: str = "shard") -> DataFrame:
    """doc_id, bytes, depth, shard, shard_bytes, shard_docs; shard is the bucket's prefix below a leading 1 bit.

    Every round counts cells of a few more bits, adds them up to all prefixes between, and gives each cell the shortest
    prefix within the limit; only documents of cells that are still too large go on to the next round. The first round has
    about a cell a shard, so what is added up follows the number of shards, not of documents.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    live = stash(docs.select("doc_id", size.alias("bytes"), id_hash(seed, "doc_id").alias("_h")), "shard-sizes", gather=True)
    total = live.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))
    done = []
    while True:
        cells = live.groupBy(F.shiftright("_h", BITS - high).alias("_cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        every = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("_prefix", F.expr(f"shiftright(_cell, {high} - depth)"))
        sums = every.groupBy("depth", "_prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), (F.min("lo") == F.max("hi")).alias("single"))
        fits = sums.where((F.col("shard_bytes") <= limit) | F.col("single"))
        leaf = every.select("_cell", "depth", "_prefix").join(fits, ["depth", "_prefix"]).groupBy("_cell").agg(F.min(F.struct("depth", "_prefix", "shard_bytes", "shard_docs")).alias("leaf"))
        leaf = stash(leaf.select(F.col("_cell").alias("_found"), "leaf.*"), "shard-directory")
        joined = live.join(leaf, F.shiftright("_h", BITS - high) == F.col("_found"), "left")
        done.append(joined.where("_found is not null").select("doc_id", "bytes", "depth", (F.expr("shiftleft(1L, depth)") + F.col("_prefix")).alias("shard"), "shard_bytes", "shard_docs"))
        rest = joined.where("_found is null").select(live.columns)
        if high == BITS or rest.isEmpty():
            break
        live, low, high = stash(rest, "shard-rest"), high + 1, min(BITS, high + 4)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20) -> None:
    """Write docs as one folder a shard, with the column ``row`` holding the table's columns; a shard is within the limit,
    so a task per shard has bounded memory."""
    at = shard(docs, limit).select(F.col("doc_id").alias("at"), "shard").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("key"))
    whole.join(at, F.col("key").eqNullSafe(F.col("at"))).select("row", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
