"""Convolutions of rasters (r, c, band, v): weights over taps inside the image, normalised by their sum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(sigma: float) -> list[tuple[int, float]]:
    """(offset, weight) of exp(-x**2 / 2 sigma**2) within three sigmas."""
    reach = int(3 * sigma)
    return [(x, math.exp(-(x**2) / (2 * sigma**2))) for x in range(-reach, reach + 1)]


def taps(pixels: DataFrame, kernel: list[tuple[int, int, float]], inside: str | None, edge: str) -> DataFrame:
    """Each pixel gives its weighted value to the pixels that have it under a tap; sums are combined before the shuffle."""
    moves = F.array(*[F.struct(F.lit(-a).alias("dr"), F.lit(-b).alias("dc"), F.lit(float(w)).alias("w")) for a, b, w in kernel])
    spread = pixels.withColumn("m", F.explode(moves)).select((F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"), "band", (F.col("m.w") * F.col("v")).alias("x"), F.col("m.w").alias("w"))
    if inside:
        spread = spread.where(inside)
    total = sum(w for _, _, w in kernel)
    norm = F.sum("w") if edge == "clamp" else F.lit(total)
    sums = spread.groupBy("r", "c", "band").agg(F.sum("x").alias("x"), norm.alias("w"))
    return sums.select("r", "c", "band", F.when(F.col("w") == 0, 0.0).otherwise(F.col("x") / F.col("w")).alias("v"))


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]], rows: int, cols: int, edge: str = "clamp") -> DataFrame:
    """2-D convolution with (row offset, column offset, weight). 'clamp' divides by the weights inside the image, 'zero' by all."""
    return taps(pixels, kernel, f"r >= 0 and r < {rows} and c >= 0 and c < {cols}", edge)


def separable(pixels: DataFrame, row_kernel: list[tuple[int, float]], col_kernel: list[tuple[int, float]], rows: int, cols: int, edge: str = "clamp") -> DataFrame:
    """Two 1-D passes: as many taps a pixel as the kernel is long, not as it is wide and long."""
    first = taps(pixels, [(0, b, w) for b, w in col_kernel], f"c >= 0 and c < {cols}", edge)
    return taps(first, [(a, 0, w) for a, w in row_kernel], f"r >= 0 and r < {rows}", edge)
