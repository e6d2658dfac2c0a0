"""Statistics and descriptors of regions over pixels (r, c[, band], v) joined with (r, c, region)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(values: DataFrame, count: int = 5) -> DataFrame:
    """(region, band, moment, value) of (region, band, v): the mean, then signed roots of central moments over factorials."""
    means = values.groupBy("region", "band").agg(F.avg("v").alias("mean"))
    apart = F.col("v") - F.col("mean")
    powers = [F.avg(F.pow(apart, F.lit(float(m + 1)))).alias(f"m{m}") for m in range(1, count)]
    both = values.join(means, ["region", "band"]).groupBy("region", "band").agg(F.first("mean").alias("m0"), *powers)
    scaled = [F.col("m0")] + [F.signum(f"m{m}") * F.pow(F.abs(f"m{m}"), F.lit(1.0 / (m + 1))) / math.factorial(m + 1) for m in range(1, count)]
    return both.select("region", "band", F.posexplode(F.array(*scaled)).alias("moment", "value"))


def sufficient(pixels: DataFrame, pixel_region: DataFrame) -> DataFrame:
    """(region, band, n, s, ss, sr, sc): sums of values, squares and places; one partial and one final aggregation."""
    v = F.col("v")
    return pixels.join(pixel_region, ["r", "c"]).groupBy("region", "band").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.sum("r").cast("double").alias("sr"), F.sum("c").cast("double").alias("sc"))


def mean_values(pixels: DataFrame, pixel_region: DataFrame) -> DataFrame:
    return pixels.join(pixel_region, ["r", "c"]).groupBy("region", "band").agg(F.avg("v").alias("mean"))


def merge_cost(edges: DataFrame, stats: DataFrame, m: float, size: float) -> DataFrame:
    """(a, b, error): what merging two regions adds to the squared error, colours plus m / size**2 times places; 0 for an empty one."""
    means = stats.groupBy("region").agg(F.first("n").cast("double").alias("n"), F.map_from_entries(F.collect_list(F.struct("band", F.col("s") / F.col("n")))).alias("mu"), F.first(F.col("sr") / F.col("n")).alias("mr"), F.first(F.col("sc") / F.col("n")).alias("mc"))
    pick = lambda s: means.select(F.col("region").alias(s), F.col("n").alias(f"n{s}"), F.col("mu").alias(f"mu{s}"), F.col("mr").alias(f"mr{s}"), F.col("mc").alias(f"mc{s}"))
    both = edges.join(pick("a"), "a").join(pick("b"), "b")
    colour = F.aggregate(F.transform(F.map_keys("mua"), lambda k: F.pow(F.element_at("mua", k) - F.element_at("mub", k), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    place = F.pow(F.col("mra") - F.col("mrb"), F.lit(2.0)) + F.pow(F.col("mca") - F.col("mcb"), F.lit(2.0))
    pooled = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    return both.select("a", "b", F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(pooled * (colour + F.lit(m / size**2) * place)).alias("error"))


def bin_counts(values: DataFrame, bins: DataFrame) -> DataFrame:
    """(region, bin, share) of (region, bin): each region's shares of all listed bins, zeros included. bins is a short list."""
    counts = values.groupBy("region", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("region").agg(F.sum("n").alias("total"))
    every = bins.agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    grid = totals.join(F.broadcast(every)).select("region", "total", F.explode("bins").alias("bin"))  # one row of bins
    return grid.join(counts, ["region", "bin"], "left").select("region", "bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def quadtree(pixels: DataFrame, pixel_region: DataFrame, levels: int = 3) -> DataFrame:
    """(region, node, band, value): mean values of quadrants at each part's mean place, depth d scaled by 4**-d.

    A node's name is the string of its quadrants: 1 upper right, 2 upper left, 3 lower left, 4 lower right.
    """
    at = pixels.join(pixel_region, ["r", "c"]).select("region", "band", "v", "r", "c", F.lit("").alias("node"))
    out = None
    for depth in range(levels):
        means = at.groupBy("region", "node", "band").agg((F.avg("v") * 4.0**-depth).alias("value"))
        out = means if out is None else out.union(means)
        if depth + 1 < levels:
            centre = at.groupBy("region", "node").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"))
            up, right = F.col("r") < F.col("mr"), F.col("c") >= F.col("mc")
            part = F.when(up & right, "1").when(up, "2").when(~right, "3").otherwise("4")
            at = at.join(centre, ["region", "node"]).select("region", "band", "v", "r", "c", F.concat("node", part).alias("node"))
    return out


def gabor_bank(octaves: int, jump: float, frequency: float, angle: float) -> list[tuple[int, int, float, float, float, float, int]]:
    """(octave, direction, centre frequency, width along it, width across it, angle, size in pixels) of each filter.

    Half-magnitude contours of neighbours touch: ``jump`` octaves apart along the frequency, ``angle`` apart around it.
    """
    along, across, half = (2**jump - 1) / (2**jump + 1), math.tan(angle / 2), math.sqrt(math.log(2) / math.pi)
    step, out = (1 + along) / (1 - along), []
    for octave in range(octaves):
        f = frequency * step**octave
        a, b = f * along / half, f * across / half
        out += [(octave, d, f, a, b, d * angle, int(2 / min(a, b))) for d in range(int(math.pi / angle))]
    return out


def gabor_transform(shape: tuple[int, int], f: float, a: float, b: float, angle: float, size: int) -> np.ndarray:
    """The filter's discrete Fourier transform over a shape: a Gaussian around its frequency, with the filter's middle as its origin."""
    y, x = (np.fft.fftfreq(n) - f * g(angle) for n, g in zip(shape, (math.sin, math.cos), strict=True))
    y = y[:, None]
    u, v = x * math.cos(angle) + y * math.sin(angle), y * math.cos(angle) - x * math.sin(angle)
    return np.exp(-math.pi * ((u / a) ** 2 + (v / b) ** 2) - 1j * math.pi * size * (x + y)) / (a * b)


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    """Pixels whose size x size neighbourhood lies in the mask, which is mirrored at its edges; an even one reaches further down and right."""
    if size < 1:
        return mask
    before, after = (size - 1) // 2, size // 2
    for axis in (0, 1):
        pad = [(before, after) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(mask, pad, "symmetric")
        mask = np.lib.stride_tricks.sliding_window_view(wide, size, axis).all(-1)
    return mask


def gabor(pixels: DataFrame, pixel_region: DataFrame, octaves: int = 2, jump: float = 1.4, frequency: float = 0.03589, angle: float = 0.698132) -> DataFrame:
    """(region, octave, direction, band, part, energy): summed squares of the real (part 0) and the imaginary (1) response of each
    region's tile, zero outside the region, to a bank of oriented filters, over pixels that half a filter covers.

    A region's tile fits one task; FFT and erosion have no short SQL form.
    """
    bank = gabor_bank(octaves, jump, frequency, angle)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = (pdf["r"] - pdf["r"].min()).to_numpy(), (pdf["c"] - pdf["c"].min()).to_numpy()
        h, w = int(at[0].max()) + 1, int(at[1].max()) + 1
        mask = np.zeros((h, w), bool)
        mask[at] = True
        for band in sorted(pdf["band"].unique()):
            pick = (pdf["band"] == band).to_numpy()
            tile = np.zeros((h, w))
            tile[at[0][pick], at[1][pick]] = pdf["v"].to_numpy()[pick]
            for octave, d, f, a, b, theta, size in bank:
                shape = (h + size - 1, w + size - 1)
                full = np.fft.ifft2(np.fft.fft2(tile, shape) * gabor_transform(shape, f, a, b, theta, size))
                skip = (size - 1) // 2
                part = full[skip : skip + h, skip : skip + w][eroded(mask, size // 2)]
                out += [(pdf["region"].iloc[0], octave, d, band, k, float((x**2).sum())) for k, x in enumerate((part.real, part.imag))]
        return pd.DataFrame(out, columns=["region", "octave", "direction", "band", "part", "energy"])

    kind = pixel_region.schema["region"].dataType.simpleString()
    rows = pixels.join(pixel_region, ["r", "c"]).select("region", "r", "c", "band", "v")
    return rows.groupBy("region").applyInPandas(run, f"region {kind}, octave int, direction int, band int, part int, energy double")


def arg_extreme(values: DataFrame, by: list[str], index: str, value: str, largest: bool) -> DataFrame:
    """Per group the index of the extreme value, the first one on ties."""
    key = F.struct((-F.col(value) if largest else F.col(value)).alias("v"), F.col(index).alias("i"))
    best = values.groupBy(*by).agg(F.min(key).alias("best"))
    return best.select(*by, F.col("best.i").alias(index), (-F.col("best.v") if largest else F.col("best.v")).alias(value))


def least_spread(pixel_labels: DataFrame) -> DataFrame:
    """(least): over superpixels, the least number of distinct labels in one."""
    return pixel_labels.groupBy("region").agg(F.countDistinct("label").alias("n")).agg(F.min("n").alias("least"))


def rounded(x: Column | str, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, places) + F.lit(0.0)
