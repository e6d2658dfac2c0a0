"""Neighbourhoods of pixels: adjacency of regions, hole filling, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle

FOUR = ((0, 1), (1, 0))
EIGHT = (*FOUR, (1, 1), (1, -1))


def shifted(pixel_region: DataFrame, steps, columns: dict[str, str]) -> DataFrame:
    """Pairs of a pixel and its neighbour one step on; each step is an equal-key join."""
    moves = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])
    there = pixel_region.select("r", "c", *[F.col(k).alias(v) for k, v in columns.items()])
    here = pixel_region.withColumn("_m", F.explode(moves)).withColumn("_r", F.col("r") + F.col("_m.dr")).withColumn("_c", F.col("c") + F.col("_m.dc")).drop("_m", "r", "c")
    return here.join(there, (F.col("_r") == there["r"]) & (F.col("_c") == there["c"]))


def adjacency(pixel_region: DataFrame) -> DataFrame:
    """(a, b), a < b: regions that touch along an edge."""
    pairs = shifted(pixel_region, FOUR, {"region": "other"}).where("region <> other")
    return pairs.select(F.least("region", "other").alias("a"), F.greatest("region", "other").alias("b")).distinct()


def fill_sweep(pixel_region: DataFrame, removable: DataFrame) -> DataFrame:
    """One synchronous sweep: a pixel of a removable region takes the first other label of up, down, left, right."""
    marked = pixel_region.join(removable.select("region").distinct().withColumn("_gone", F.lit(True)), "region", "left").select("r", "c", "region", F.coalesce("_gone", F.lit(False)).alias("gone"))
    kept = marked.where("not gone").select("r", "c", "region")
    holes = marked.where("gone").select("r", "c", "region")
    sides = ((1, 0), (-1, 0), (0, 1), (0, -1))  # where a kept pixel's label goes, so that it comes from up, down, left, right
    offers = kept.select(F.posexplode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in sides])).alias("side", "at"), F.col("region").alias("new"))
    best = offers.select("at.r", "at.c", F.struct("side", "new").alias("offer")).groupBy("r", "c").agg(F.min("offer").alias("offer"))
    filled = holes.join(best, ["r", "c"], "left").select("r", "c", F.coalesce("offer.new", "region").alias("region"))
    return kept.union(filled)


def fill_sweeps(pixel_region: DataFrame, removable: DataFrame, sweeps: int = 64, tile: int = 256) -> DataFrame:
    """As many sweeps as ``sweeps`` in one pass: a label comes no further than a pixel a sweep, so a square tile and a margin of
    ``sweeps`` pixels around it hold all that decides its own pixels. Tiles without removable pixels are left as they are.

    Removable pixels that still have their label stay removable; (r, c, region, gone).
    """
    if sweeps > tile:
        raise ValueError("a margin is no wider than a tile")
    gone = F.col("gone") if "gone" in pixel_region.columns else F.coalesce("_gone", F.lit(False))
    marked = pixel_region if "gone" in pixel_region.columns else pixel_region.join(removable.select("region").distinct().withColumn("_gone", F.lit(True)), "region", "left")
    marked = marked.select("r", "c", "region", gone.alias("gone"))
    box = lambda x: F.floor(x / tile).cast("long")
    own = marked.withColumn("tr", box(F.col("r"))).withColumn("tc", box(F.col("c")))
    todo = own.where("gone").select("tr", "tc").distinct()
    spread = marked
    for x, t in (("r", "tr"), ("c", "tc")):
        spread = spread.withColumn(t, F.explode(F.array_distinct(F.array(box(F.col(x) - sweeps), box(F.col(x)), box(F.col(x) + sweeps)))))
    kind = pixel_region.schema["region"].dataType.simpleString()

    def run(key, pdf):
        tr, tc = key
        top, left, side = tr * tile - sweeps, tc * tile - sweeps, tile + 2 * sweeps + 2
        at = (pdf["r"].to_numpy() - top + 1).astype(int), (pdf["c"].to_numpy() - left + 1).astype(int)
        here, hole = np.full((side, side), -1), np.zeros((side, side), bool)  # row of the label, and a rim without pixels
        here[at], hole[at] = np.arange(len(pdf)), pdf["gone"].to_numpy()
        known = (here >= 0) & ~hole
        for _ in range(sweeps):
            new = here.copy()
            for step, axis in ((-1, 1), (1, 1), (-1, 0), (1, 0)):  # right, left, down, up: the later one wins
                from_, ok = np.roll(here, step, axis), np.roll(known, step, axis) & hole
                new[ok] = from_[ok]
            done = hole & (new != here)
            if not done.any():
                break
            here, hole, known = new, hole & ~done, known | done
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        mine = (r // tile == tr) & (c // tile == tc)
        out = pdf[["r", "c"]][mine].copy()
        out["region"] = pdf["region"].to_numpy()[here[at][mine]]
        out["gone"] = hole[at][mine]
        return out

    kinds = {x: pixel_region.schema[x].dataType.simpleString() for x in "rc"}
    filled = spread.join(todo, ["tr", "tc"]).groupBy("tr", "tc").applyInPandas(run, f"r {kinds['r']}, c {kinds['c']}, region {kind}, gone boolean")
    return own.join(todo, ["tr", "tc"], "left_anti").select("r", "c", "region", "gone").union(filled)


def fill_holes(pixel_region: DataFrame, removable: DataFrame, sweeps: int = 64) -> DataFrame:
    """Sweeps until no removable pixel is left or none can change, ``sweeps`` of them in a pass."""
    before, marked = None, pixel_region
    while True:
        marked = settle(fill_sweeps(marked, removable, sweeps))
        left = marked.where("gone").count()
        if left in (0, before):
            return marked.select("r", "c", "region")
        before = left


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges (a, b) connect a node with; loops over rounds that halve chains."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        low = labels.join(heard, "node").select("node", F.least("label", "heard").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = settle(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), "old"))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def relabel(pixel_region: DataFrame, width: int) -> DataFrame:
    """(r, c, region, label): 8-connected parts of equal region, each named by its first pixel r * width + c."""
    pixels = pixel_region.withColumn("p", F.col("r") * width + F.col("c"))
    pairs = shifted(pixels, EIGHT, {"region": "other", "p": "q"}).where("region = other")
    labels = least_labels(pairs.select(F.col("p").alias("a"), F.col("q").alias("b")))
    return pixels.join(labels, pixels["p"] == labels["node"], "left").select("r", "c", "region", F.coalesce("label", "p").alias("label"))
