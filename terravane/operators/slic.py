"""Superpixels: pixels (r, c, v array) join the best of the centres near them, centres move to their pixels' means."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .graph import distance2
from .neighbours import fill_holes, relabel


def size_of(rows: int, cols: int, k: int) -> int:
    return max(1, int(math.sqrt(rows * cols / k)))


def grid_centres(pixels: DataFrame, size: int) -> DataFrame:
    """(k, r, c, v): a centre at the middle of every box of the grid, with the box's mean value."""
    box_r, box_c = F.floor(F.col("r") / size), F.floor(F.col("c") / size)
    n = F.size(F.first("v"))
    mean = F.transform(F.sequence(F.lit(1), n), lambda i: i)
    wide = pixels.groupBy(box_r.alias("br"), box_c.alias("bc")).agg(F.avg("r").alias("r"), F.avg("c").alias("c"), F.collect_list("v").alias("vs"), mean.alias("at"))
    value = F.transform("at", lambda i: F.aggregate(F.transform("vs", lambda v: F.element_at(v, i)), F.lit(0.0), lambda s, x: s + x) / F.size("vs"))
    return wide.select((F.shiftleft(F.col("br").cast("long"), 32) + F.col("bc")).alias("k"), "r", "c", value.alias("v"))


def assign(pixels: DataFrame, centres: DataFrame, size: int, m: float) -> DataFrame:
    """(r, c, v, k, score): the best centre of the 3 x 3 boxes around a pixel's box, within two sizes; null where there is none.

    Centres are copied to the nine boxes that may want them and gathered there, so every pixel meets one list of its box.
    """
    box = lambda x: F.floor(F.col(x) / size)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = centres.withColumn("_s", near).groupBy((box("r") + F.col("_s.a")).alias("br"), (box("c") + F.col("_s.b")).alias("bc"))
    spread = spread.agg(F.collect_list(F.struct("k", "r", "c", "v")).alias("_near"))
    there = lambda x, side: (F.col(side) - x[side]) / size
    ok = F.filter("_near", lambda x: (F.abs(there(x, "r")) < 2) & (F.abs(there(x, "c")) < 2))
    score = lambda x: F.lit(float(m * m)) * (there(x, "r") * there(x, "r") + there(x, "c") * there(x, "c")) + distance2(F.col("v"), x["v"])
    best = F.array_min(F.transform(ok, lambda x: F.struct(score(x).alias("score"), x["k"].alias("k"))))
    rows = pixels.withColumn("br", box("r")).withColumn("bc", box("c")).join(spread, ["br", "bc"], "left")
    return rows.withColumn("b", best).select("r", "c", "v", "b.k", "b.score")


def update(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """(k, r, c, v): means of the pixels of each centre; a centre without pixels stays."""
    cells = assigned.where("k is not null").select("k", "r", "c", F.posexplode("v").alias("band", "x"))
    sums = cells.groupBy("k", "band").agg(F.avg("x").alias("x"), F.avg("r").alias("r"), F.avg("c").alias("c"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda s: s["x"])
    moved = sums.groupBy("k").agg(F.first("r").alias("_r"), F.first("c").alias("_c"), values.alias("_v"))
    return centres.join(moved, "k", "left").select("k", F.coalesce("_r", "r").alias("r"), F.coalesce("_c", "c").alias("c"), F.coalesce("_v", "v").alias("v"))


def random_centres(pixels: DataFrame, rows: int, cols: int, k: int, seed: int) -> DataFrame:
    """(k, r, c, v): k seeded places, evenly spread by chance, with values of 0."""
    bands = (pixels.select(F.size("v").alias("n")).first() or [0])[0]
    place = lambda n, s: F.rand(s) * n
    zero = F.array(*[F.lit(0.0)] * bands).cast("array<double>")
    return pixels.sparkSession.range(k, numPartitions=1).select(F.col("id").alias("k"), place(rows, 2 * seed).alias("r"), place(cols, 2 * seed + 1).alias("c"), zero.alias("v"))


def converged(pixels: DataFrame, centres: DataFrame, size: int, m: float, most: int, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame, float]:
    """(assigned, centres, total distance) once the total distance repeats, or after ``most`` rounds."""
    last, total, assigned = None, 0.0, None
    for _ in range(most):
        assigned = settle(assign(pixels, centres, size, int(m)))
        total = assigned.agg(F.coalesce(F.sum(F.sqrt("score")), F.lit(0.0))).first()[0]
        if last is not None and abs(last - total) <= tolerance * max(1.0, total):
            break
        last, centres = total, settle(update(assigned, centres))
    return assigned, centres, total


def cleaned(assigned: DataFrame, cols: int, least_size: int) -> DataFrame:
    """(r, c, region): connected parts, small ones filled from their neighbours."""
    parts = settle(relabel(assigned.select("r", "c", F.coalesce("k", F.lit(-1)).alias("region")), cols).select("r", "c", F.col("label").alias("region")))
    small = settle(parts.groupBy("region").count().where(F.col("count") < least_size).select("region"))
    return relabel(fill_holes(parts, small), cols).select("r", "c", F.col("label").alias("region"))


def slic(pixels: DataFrame, rows: int, cols: int, tile: int, m: float = 20.0, most: int = 1000, least_size: int = 32, tolerance: float = 0.0, runs: int = 1, tries: int = 1, seed: int = 1) -> DataFrame:
    """(r, c, region) of the run with the least total distance, then connected parts, small ones filled from their neighbours.

    The first run starts from a grid, further ones from seeded random places. A run has ``tries`` rounds of convergence; between
    them centres of fewer than ``least_size`` pixels go.
    """
    k = max(1, rows * cols // tile**2)
    size, best = size_of(rows, cols, k), None
    for run in range(runs):
        centres = settle(random_centres(pixels, rows, cols, k, seed + run) if run else grid_centres(pixels, size))
        for attempt in range(tries):
            assigned, centres, total = converged(pixels, centres, size, m, most, tolerance)
            large = assigned.groupBy("k").count().where(F.col("count") >= least_size)
            if attempt + 1 < tries:
                left = settle(centres.join(large.select("k"), "k", "left_semi"))
                if left.isEmpty() or left.count() == centres.count():
                    break
                centres = left
        best = (total, assigned) if best is None or total < best[0] else best
    return cleaned(best[1], cols, least_size)
