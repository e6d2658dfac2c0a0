"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get blocks of ``block_words`` words by highest quotients of their targets, each source's
blocks are apportioned to its shards in the same way, and a shard takes its quota as a seeded run
of blocks around its seeded document order. Only DataFrame functions are used.

Edge cases: a null text counts 0 words and takes 0; a null source is a source of its own, last in
order; equal doc_ids are told apart by size only, so repeated rows may swap their shares but not
change them as a set; an empty table gives no rows. Other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, id_hash, stash, unboxed


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, capped at ``most`` times the size, the excess reshared.

    Sharing again until none is above its cap ends at the level L with sum(min(cap, L * weight)) = total; in order of
    cap / weight the capped sources come first, so one pass over prefix sums finds L.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap, weight = F.col("cap"), F.col("weight")
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", cap / weight)
        .withColumn("level", level)
        .withColumn("level", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole))
        .withColumn("target", F.least(cap, F.coalesce(weight * F.col("level"), cap)))
        .drop("weight", "cap", "ratio", "level")
    )


def sainte_lague(df: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: how many of the group's ``seats`` each row gets by the highest quotients weight / (2k + 1).

    A divisor that hands out all H seats lies within n / 2H of the ideal one (n rows of weight), so seats below that
    range are sure and only about four quotients a row are ranked; ties go by ``order``.
    """
    every = Window.partitionBy(*group)
    n = F.sum(F.when(F.col(weight) > 0, 1.0).otherwise(0.0)).over(every)
    ideal, slack = F.col("_ideal"), F.col("_n") / (2.0 * F.col(seats))
    ranked = (
        df.withColumn("_n", n)
        .withColumn("_ideal", F.when((F.col(seats) > 0) & (F.col(weight) > 0), F.col(weight) * F.col(seats) / F.sum(weight).over(every)).otherwise(0.0))
        .withColumn("_sure", F.when(ideal > 0, F.greatest(F.lit(0), F.ceil(ideal * (1 - slack) - 0.5) - 1)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_top", F.when(ideal > 0, F.floor(ideal * (1 + slack) + 0.5) + 1).otherwise(F.lit(0)).cast("long"))
        .withColumn("_free", F.col(seats) - F.sum("_sure").over(every))
        .withColumn("_k", F.explode_outer(F.when(F.col("_top") > F.col("_sure"), F.sequence("_sure", F.col("_top") - 1))))
        .withColumn("_q", F.col(weight) / (2.0 * F.col("_k") + 1.0))
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_free")), 1).otherwise(0))
    return ranked.withColumn("_place", place).groupBy(*df.columns).agg((F.first("_sure") + won).alias(out))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 256, shard_words: int = 1 << 17, max_shards: int = 1 << 16, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, shard, taken: the words that the mix takes of each document.

    Blocks hold ``block_words`` words, or fewer if the smallest target would get under 64 of them. A source is dealt
    into shards of about ``shard_words`` words, so a hot source is spread over many tasks. A source's shards are ranked in one
    task, a few quotients each, so there are ``max_shards`` at most; beyond that shards grow, and their narrow rows are sorted on disk.
    """
    key = id_hash(seed, "doc_id")
    sized = stash(docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key")), "mix-sizes", gather=True)
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = Window.partitionBy()
    block = F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole) / 64))).cast("long")
    by_source = (
        by_source.withColumn("block", F.coalesce(block, F.lit(1)))
        .withColumn("blocks", F.round(F.sum("target").over(whole) / F.col("block")).cast("long"))
        .withColumn("shards", F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    )
    by_source = sainte_lague(by_source, ["block", "blocks"], ["source"], "target", "blocks", "source_blocks")
    by_source = stash(by_source.select(F.col("source").alias("_source"), "source_size", "target", "block", "shards", "source_blocks"), "mix-sources")

    rows = sized.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod("_key", F.col("shards")))
    by_shard = rows.groupBy("_source", "block", "source_blocks", "shard").agg(F.sum("size").cast("double").alias("words"))
    quotas = sainte_lague(by_shard, ["_source", "source_blocks"], ["shard"], "words", "source_blocks", "quota")
    place = id_hash(seed + "-start", "_source", "shard")
    quotas = quotas.select(
        F.col("_source").alias("_qsource"), F.col("shard").alias("_qshard"), F.col("words").cast("long").alias("words"),
        F.least(F.col("quota") * F.col("block"), (F.lit(most) * F.col("words")).cast("long")).alias("take"),
        (F.pmod(place, F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block")))) * F.col("block")).cast("long").alias("start"),
    )
    rows = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_qsource")) & (F.col("shard") == F.col("_qshard")))
    end = F.sum("size").over(Window.partitionBy("_source", "shard").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    words, start, size = F.greatest(F.lit(1), F.col("words")), F.col("start"), F.col("size")
    rest = F.pmod("take", words)
    part = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_end") - size, a))
    run = part(start, F.least(F.col("words"), start + rest)) + part(F.lit(0), start + rest - F.col("words"))
    taken = (F.floor(F.col("take") / words) * size + run).cast("long")
    return rows.withColumn("_end", end).select("doc_id", "source", "size", "source_size", "target", "shard", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: each document as often as its taken words ask for, the fraction settled by a seeded draw.

    Rows that share a doc_id and a size take the mean of what the mix takes of them, with a draw for each, so that together they
    come to what it takes of all of them.
    """
    key, size, share = F.col("key"), F.col("size"), F.col("_taken") / F.col("size")
    many = mix(docs, seed=seed, **options).where("taken > 0 or size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"))
    many = many.agg(F.avg("taken").alias("_taken"), F.count("*").alias("_rows")).where("_taken > 0")
    rows = boxed(docs, key=docs["doc_id"], size=word_count(), any=F.monotonically_increasing_id())
    rows = rows.join(many, key.eqNullSafe(F.col("_id")) & (size == F.col("_size")))
    alone, shared = id_hash(seed + "-draw", "key"), id_hash(seed + "-draw", "key", "any")
    draw = F.when(F.col("_rows") == 1, alone).otherwise(shared) / F.lit(float(1 << 60))
    often = F.floor(share + draw).cast("int")
    return unboxed(rows.withColumn("_n", often).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))), docs.columns)
