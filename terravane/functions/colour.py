"""Colour spaces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ, its inverse, and the D65 white point.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
TO_RGB = ((3.240481342761, -1.537151516271, -0.498536326168), (-0.969254949997, 1.875990001490, 0.041555926558), (0.055646639135, -0.204041338367, 1.057311069645))
WHITE = (0.95047, 1.0, 1.08883)


def lab(red: Column, green: Column, blue: Column) -> list[Column]:
    """L, a, b of sRGB in 0..1."""
    linear = [F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92) for x in (red, green, blue)]
    xyz = [(m[0] * linear[0] + m[1] * linear[1] + m[2] * linear[2]) / w for m, w in zip(TO_XYZ, WHITE, strict=True)]
    f = [F.when(x > 0.008856, F.pow(x, F.lit(1.0 / 3.0))).otherwise(7.787 * x + 16.0 / 116.0) for x in xyz]
    return [116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])]


def rgb(lightness: Column, a: Column, b: Column) -> list[Column]:
    """sRGB of L, a, b, clipped to 0..1."""
    fy = (lightness + 16.0) / 116.0
    f = [fy + a / 500.0, fy, F.greatest(fy - b / 200.0, F.lit(0.0))]
    xyz = [F.when(x > 0.2068966, F.pow(x, F.lit(3.0))).otherwise((x - 16.0 / 116.0) / 7.787) * w for x, w in zip(f, WHITE, strict=True)]
    linear = [m[0] * xyz[0] + m[1] * xyz[1] + m[2] * xyz[2] for m in TO_RGB]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 0.0031308, 1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * x))) for x in linear]
