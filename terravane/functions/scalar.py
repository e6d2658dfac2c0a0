"""Scalar helpers: safe division, clamps, small matrices, and the arguments of scales."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def safe_normalise(value: Column, norm: Column) -> Column:
    """value / norm, 0 where the norm is next to nothing."""
    return F.when(F.abs(norm) < TINY, 0.0).otherwise(value / norm)


def inverse_or_zero(x: Column) -> Column:
    """1 / x; the largest number of the sign of x = 0 or too small for that, 0 for what is no number."""
    big = F.lit(1.7976931348623157e308)
    inverse = F.least(big, F.greatest(-big, F.try_divide(F.lit(1.0), x)))
    return F.when(F.isnan(x) | x.isNull(), 0.0).when(x == 0, F.when(x.cast("string").startswith("-"), -big).otherwise(big)).otherwise(inverse)


def descend(value: Column, gradient: Column, fix: Column, norm: Column, step: Column | float) -> Column:
    """A non-negative value after a step along its gradient, corrected for the norm of its column."""
    inverse = F.when(F.abs(norm) <= TINY, 0.0).otherwise(1.0 / norm)
    return F.greatest(F.lit(0.0), value + step * (gradient * inverse - fix * inverse * inverse))


def number_of_regions(rows: int, cols: int, size: float) -> int:
    return int(rows * cols / size**2)


def geometric_scales(low: float, high: float, levels: int | None = None, decay: float | None = None) -> list[float]:
    """Scales from high down by a constant factor (given, or from the number of levels) while they are not under low."""
    decay = (low / high) ** (1.0 / levels) if levels else decay
    if not decay or not 0 < decay < 1:
        raise ValueError("the decay must lie between 0 and 1")
    many = int(math.floor(math.log(low / high) / math.log(decay) + 1e-9)) + 1
    return [high * decay**k for k in range(min(many, levels or many))]


def percent_or_absolute(text: str, relative: float) -> float:
    """'5%' of relative, or the number itself."""
    return float(text[:-1]) / 100.0 * relative if text.endswith("%") else float(text)


def small_matrix(op: str, a: list, b: list | None = None):
    """dot, mul, mul_t (a times b transposed), det and inv of square matrices of up to eight rows; det and inv take up to four."""
    x = np.asarray(a, float)
    if x.shape[0] not in (1, 2, 3, 4, 8) or op in ("det", "inv") and x.shape[0] > 4:
        raise ValueError(f"no {op} of {x.shape[0]} rows")
    y = None if b is None else np.asarray(b, float)
    return {"dot": lambda: x @ y, "mul": lambda: x @ y, "mul_t": lambda: x @ y.T, "det": lambda: np.linalg.det(x), "inv": lambda: np.linalg.inv(x)}[op]()


def _cell(a: Column, n: int, i: int, j: int) -> Column:
    return F.element_at(a, i * n + j + 1)


def matrix_times(a: Column, b: Column, n: int) -> Column:
    """The product of two n x n matrices, held as arrays of their rows one after another."""
    return F.array(*[sum((_cell(a, n, i, k) * _cell(b, n, k, j) for k in range(1, n)), _cell(a, n, i, 0) * _cell(b, n, 0, j)) for i in range(n) for j in range(n)])


def matrix_times_transposed(a: Column, b: Column, n: int) -> Column:
    """a times the transpose of b."""
    return F.array(*[sum((_cell(a, n, i, k) * _cell(b, n, j, k) for k in range(1, n)), _cell(a, n, i, 0) * _cell(b, n, j, 0)) for i in range(n) for j in range(n)])


def matrix_dot(a: Column, x: Column, n: int) -> Column:
    """An n x n matrix times a vector."""
    return F.array(*[sum((_cell(a, n, i, k) * F.element_at(x, k + 1) for k in range(1, n)), _cell(a, n, i, 0) * F.element_at(x, 1)) for i in range(n)])


def _minor(a: Column, n: int, rows: tuple[int, ...], cols: tuple[int, ...]) -> Column:
    if len(rows) == 1:
        return _cell(a, n, rows[0], cols[0])
    parts = [_cell(a, n, rows[0], c) * _minor(a, n, rows[1:], cols[:k] + cols[k + 1 :]) for k, c in enumerate(cols)]
    out = parts[0]
    for k, part in enumerate(parts[1:], 1):
        out = out - part if k % 2 else out + part
    return out


def determinant(a: Column, n: int) -> Column:
    """Of matrices of up to four rows, by expansion along the first row."""
    if n > 4:
        raise ValueError(f"no determinant of {n} rows")
    return _minor(a, n, tuple(range(n)), tuple(range(n)))


def inverse(a: Column, n: int) -> Column:
    """Of matrices of up to four rows, by their minors; null for singular ones."""
    det = determinant(a, n)
    rest = lambda k: tuple(x for x in range(n) if x != k)
    cells = [(_minor(a, n, rest(j), rest(i)) if n > 1 else F.lit(1.0)) * (-1) ** (i + j) for i in range(n) for j in range(n)]
    return F.when(det != 0, F.transform(F.array(*cells), lambda x: F.try_divide(x, det)))
