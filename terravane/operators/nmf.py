"""Non-negative factorisation of powers of a column-stochastic matrix, D**s ~ F G with columns of F and G that sum to 1.

Graphs of regions are small beside their pixels: up to ``MOST`` rows they are factorised on the driver in numpy. Larger ones stay
tables (``factorise_tables``): many starting points diffuse at once, columns are solved where they are, and only matrices of
components by components come to the driver. Only the factors of several runs, side by side, are combined on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TINY, descend, safe_normalise
from ..sources.tables import settle
from .graph import power_times, times
from .linalg import inner, product, transpose

MOST = 4000


def normalised(m: DataFrame) -> DataFrame:
    """Columns divided by their sums."""
    sums = m.groupBy("j").agg(F.sum("v").alias("s"))
    return m.join(sums, "j").select("i", "j", safe_normalise(F.col("v"), F.col("s")).alias("v"))


def gradient_step(matrix: DataFrame, gamma: DataFrame, delta: DataFrame, steps: int, rate: float) -> tuple[DataFrame, DataFrame]:
    """New (gamma, delta) after one step; gamma is n x r and delta r x n, as (i, j, v), matrix (i, j, w)."""
    f, g = normalised(gamma), normalised(delta)
    columns = lambda m: m.select("i", F.col("j").alias("comp"), "v")
    back = lambda m: m.select("i", F.col("comp").alias("j"), "v")
    turned = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    f_grad = minus(back(power_times(matrix, columns(transpose(g)), steps)), product(f, product(g, transpose(g))))
    g_grad = minus(transpose(back(power_times(turned, columns(f), steps))), product(product(transpose(f), f), g))
    return moved(gamma, f_grad, rate), moved(delta, g_grad, rate)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("i", "j", "v").union(b.select("i", "j", (-F.col("v")).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def moved(values: DataFrame, gradient: DataFrame, rate: float) -> DataFrame:
    rows = values.join(gradient.withColumnRenamed("v", "g"), ["i", "j"], "left").fillna(0.0, ["g"])
    sums = rows.groupBy("j").agg(F.sum("v").alias("n"), F.sum(F.col("g") * F.col("v")).alias("fix"))
    return rows.join(sums, "j").select("i", "j", descend(F.col("v"), F.col("g"), F.col("fix"), F.col("n"), F.lit(rate)).alias("v"))


# ---- on the driver ---------------------------------------------------------------------------------------------------


def collected(matrix: DataFrame) -> tuple[list, np.ndarray]:
    """(ids, dense matrix) of (i, j, w), of MOST rows at most."""
    ids = [r.i for r in matrix.select("i").union(matrix.select("j")).distinct().orderBy("i").limit(MOST + 1).collect()]
    if len(ids) > MOST:
        raise ValueError(f"the driver takes matrices of up to {MOST} rows; factorise_tables takes any")
    at = {x: n for n, x in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in matrix.toLocalIterator():
        m[at[r.i], at[r.j]] = r.w
    return ids, m


def columns_to_one(m: np.ndarray) -> np.ndarray:
    s = m.sum(0, keepdims=True)
    return np.divide(m, s, out=np.zeros_like(m), where=np.abs(s) >= TINY)


def power(m: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(int(steps)):
        x = m @ x
    return x


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets, for the normal equations a x = b."""
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        w = b - a @ x
        w[free] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-10:
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if z[free].min(initial=1) > 0:
                x = z
                break
            low = free & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x


def nnls_to_sum(gram: np.ndarray, right: np.ndarray, target: float = 1.0) -> np.ndarray:
    """A column that solves the normal equations without negative entries and sums to a target: the sum is a heavy equation of its own."""
    weight = 1e4 * max(1.0, float(np.trace(gram)) / max(1, len(gram)))
    x = nnls(gram + weight, right + weight * target)
    s = x.sum()
    return x * (target / s) if s > 0 else np.full(len(right), target / len(right))


def solve_g(m: np.ndarray, f: np.ndarray, steps: int) -> np.ndarray:
    """G with columns that sum to 1, given F: right sides come from the transposed power."""
    gram, right = f.T @ f, power(m.T, f, steps).T
    return np.stack([nnls_to_sum(gram, right[:, j]) for j in range(m.shape[0])], axis=1)


def solve_f(m: np.ndarray, g: np.ndarray, steps: int) -> np.ndarray:
    """F with columns that sum to 1, given G."""
    gram, right = g @ g.T, power(m, g.T, steps)
    return columns_to_one(np.stack([nnls(gram, right[i]) for i in range(m.shape[0])]))


def error(m: np.ndarray, f: np.ndarray, g: np.ndarray, steps: int) -> float:
    """||D**s - F G||**2 less its constant part."""
    return float(((f.T @ f) * (g @ g.T)).sum() - 2 * (f * power(m, g.T, steps)).sum())


def single_start(m: np.ndarray, steps: int, rng: np.random.Generator) -> np.ndarray:
    """F of diffused points: each covers the points whose heat falls in one more step; the next starts at one not covered."""
    unused, columns = np.ones(len(m), bool), []
    while unused.sum() > 1:
        i = int(rng.choice(np.flatnonzero(unused)))
        x = np.zeros(len(m))
        x[i] = 1
        x = power(m, x, steps)
        x /= max(x.sum(), 1e-300)
        unused &= ~(m @ x < x)
        unused[i] = False
        columns.append(x)
    return np.stack(columns, axis=1) if columns else np.ones((len(m), 1)) / len(m)


def start(m: np.ndarray, steps: int, tries: int = 25, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """The best of seeded starting points: stops after ``tries`` in a row that do not improve."""
    rng, best, idle = np.random.default_rng(seed), None, 0
    while idle < tries:
        f = single_start(m, steps, rng)
        g = solve_g(m, f, steps)
        e = error(m, f, g, steps)
        idle = 0 if best is None or e < best[2] - 1e-12 else idle + 1
        best = (f, g, e) if best is None or e < best[2] else best
    return best


def descend_on_driver(m: np.ndarray, gamma: np.ndarray, delta: np.ndarray, steps: int, most: int = 4000, stop: float = 1e-16, rate: float = 2000.0, target: float = 5.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Steps that lower the error, by no more than ``target``, are taken; others halve the rate. Stops at a taken step under ``stop``."""
    f, g = columns_to_one(gamma), columns_to_one(delta)
    now = error(m, f, g, steps)
    for _ in range(most):
        if rate < 1e-9:
            break
        grads = power(m, g.T, steps) - f @ (g @ g.T), power(m.T, f, steps).T - (f.T @ f) @ g
        new = []
        for x, grad in zip((gamma, delta), grads, strict=True):
            n, fix = x.sum(0), (grad * x).sum(0)
            inv = np.where(np.abs(n) <= TINY, 0, 1 / np.where(n == 0, 1, n))
            new.append(np.maximum(0, x + rate * (grad * inv - fix * inv**2)))
        f2, g2 = columns_to_one(new[0]), columns_to_one(new[1])
        e = error(m, f2, g2, steps)
        drop = now - e
        if 0 <= drop <= target:
            (gamma, delta), f, g, now = new, f2, g2, e
            if drop < stop:
                break
        else:
            rate *= 0.5 if drop < 0 else target / drop
    return f, g, now


def factorise(m: np.ndarray, steps: int = 5, tries: int = 25, most: int = 4000, seed: int = 1, stop: float = 1e-16) -> tuple[np.ndarray, np.ndarray, float]:
    f, g, _ = start(m, steps, tries, seed)
    return descend_on_driver(m, f, g, steps, most, stop)


def projected(m: np.ndarray, runs: int = 1, steps: int = 5, correct: bool = True, seed: int = 1, guesses: int = 1, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Factors of a sample of 30 points a component, extended to all points, the best of ``runs``; all points where there are fewer."""
    rng = np.random.default_rng(seed)
    r = (single_start(m, steps, rng) if guesses <= 1 else start(m, steps, guesses, seed)[0]).shape[1]
    if 30 * r >= len(m):
        return factorise(m, steps, seed=seed, **options)
    best = None
    for _ in range(runs):
        pick = np.sort(rng.permutation(len(m))[: 30 * r])
        unit = np.zeros((len(m), len(pick)))
        unit[pick, np.arange(len(pick))] = 1
        part = columns_to_one(power(m, unit, steps)[pick])
        f, g, _ = factorise(part, 1, seed=int(rng.integers(1 << 31)), **options)
        wide = power(m, unit, steps) @ g.T
        f = columns_to_one(wide @ np.linalg.pinv(g @ g.T)).clip(0)
        f = columns_to_one(f)
        g = solve_g(m, f, steps)
        e = error(m, f, g, steps)
        best = (f, g, e) if best is None or e < best[2] else best
    return descend_on_driver(m, best[0], best[1], steps) if correct else best


def boosted(m: np.ndarray, main=projected, runs: int = 6, steps: int = 5, boost: int = 5, seed: int = 1, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """An ensemble: the factors of several runs side by side form a small stochastic matrix, whose own factors merge alike components.

    The small matrix is factorised ``boost`` times and the least error counts; without, the best single run is the result.
    """
    single = [main(m, steps=steps, seed=seed + k, **options) for k in range(runs)]
    if not boost:
        return min(single, key=lambda x: x[2])
    f, g = combined(np.hstack([x[0] for x in single]), np.vstack([x[1] for x in single]), boost, seed, **options)
    return f, g, error(m, f, g, steps)


def combined(f: np.ndarray, g: np.ndarray, boost: int, seed: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """Factors with components merged, from those of several runs side by side."""
    f, g = columns_to_one(f), columns_to_one(g)
    small = columns_to_one(g @ f)
    sf, sg, _ = min((projected(small, steps=2, seed=seed + k, **options) for k in range(boost)), key=lambda x: x[2])
    return f @ sf, sg @ g


def make_random(n: int, r: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(D, F, G): a stochastic matrix that is the product of two: uniform numbers, two places of every row raised, columns to 1."""
    rng = np.random.default_rng(seed)
    f, g = rng.random((n, r)), rng.random((r, n))
    for x in (f, g):
        for _ in range(2):
            x[np.arange(len(x)), rng.integers(0, x.shape[1], len(x))] += 10 * rng.random(len(x))
    f, g = columns_to_one(f), columns_to_one(g)
    return f @ g, f, g


def better_than_random(m: np.ndarray, found: float, r: int, steps: int, restarts: int = 20, seed: int = 1, sure: float = 0.95) -> tuple[float, float, float]:
    """The share of random starts whose descent ends at a lower error than found, and its confidence interval."""
    rng = np.random.default_rng(seed)
    wins = sum(descend_on_driver(m, rng.random((len(m), r)), rng.random((r, len(m))), steps, 50)[2] < found for _ in range(restarts))
    return wins / restarts, *confidence(wins, restarts, sure)


def confidence(wins: int, of: int, sure: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share (Clopper and Pearson): shares under which as many wins or more, or as few or fewer, are too rare."""
    rare = (1 - sure) / 2

    def at_least(k: int, p: float) -> float:
        return sum(math.comb(of, x) * p**x * (1 - p) ** (of - x) for x in range(k, of + 1))

    def root(rises) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if rises(mid) else (mid, high)
        return (low + high) / 2

    return (0.0 if not wins else root(lambda p: at_least(wins, p) > rare)), (1.0 if wins == of else root(lambda p: 1 - at_least(wins + 1, p) < rare))


# ---- on tables -------------------------------------------------------------------------------------------------------


def gathered(m: DataFrame, by: str, at: str) -> DataFrame:
    """(by, x): the entries of each row (or column) as an array of (place, value)."""
    return m.groupBy(by).agg(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), "v")).alias("x"))


def small_product(a: DataFrame, b: DataFrame) -> np.ndarray:
    """a' b of two tall matrices (i, j, v): as many numbers as they have columns, which come to the driver."""
    cells = product(transpose(a), b).collect()
    out = np.zeros((1 + max((c.i for c in cells), default=0), 1 + max((c.j for c in cells), default=0)))
    for c in cells:
        out[c.i, c.j] = c.v
    return out


def columns_solved(gram: np.ndarray, right: DataFrame, to_one: bool) -> DataFrame:
    """(i, j, v): for each row of right (i, j, v) the non-negative solution of the normal equations, which sums to 1 if asked."""
    r = len(gram)

    def run(batches):
        for pdf in batches:
            out = []
            for i, x in zip(pdf["i"], pdf["x"], strict=True):
                b = np.zeros(r)
                for cell in x:
                    b[cell["at"]] = cell["v"]
                y = nnls_to_sum(gram, b) if to_one else nnls(gram, b)
                out += [(i, j, v) for j, v in enumerate(y.tolist()) if v]
            yield pd.DataFrame(out, columns=["i", "j", "v"])

    return gathered(right, "i", "j").mapInPandas(run, "i long, j long, v double")


def start_tables(matrix: DataFrame, steps: int, seed: int = 1, batch: int = 32) -> DataFrame:
    """F (i, j, v) of diffused points, as ``single_start`` with points in order of a seeded hash.

    The next ``batch`` points that nothing covers diffuse together; of these, one that an earlier one covers is passed over.
    """
    points = settle(matrix.select(F.col("i").cast("long").alias("i")).union(matrix.select(F.col("j").cast("long"))).distinct().withColumn("turn", F.xxhash64("i", F.lit(seed))))
    m = matrix.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w")
    unused, out, many = points, None, 0
    while unused.limit(2).count() > 1:
        picked = [r.i for r in unused.orderBy("turn", "i").limit(batch).collect()]
        seeds = matrix.sparkSession.createDataFrame([(x, k, 1.0) for k, x in enumerate(picked)], "i long, comp int, v double")
        heat = settle(power_times(m, seeds, steps))
        heat = settle(heat.join(heat.groupBy("comp").agg(F.sum("v").alias("s")), "comp").select("i", "comp", (F.col("v") / F.col("s")).alias("v")))
        falls = times(m, heat).withColumnRenamed("v", "next")
        covered = settle(heat.join(falls, ["i", "comp"], "left").where(F.coalesce("next", F.lit(0.0)) < F.col("v")).select("i", "comp"))
        hides = {(r.comp, r.i) for r in covered.where(F.col("i").isin(picked)).collect()}  # batch times batch
        takes: list[int] = []
        left = unused.count()
        for k, x in enumerate(picked):
            if not any((t, x) in hides for t in takes):
                takes.append(k)
        names = F.create_map(*[F.lit(v) for k, t in enumerate(takes) for v in (t, many + k)])
        chosen = heat.where(F.col("comp").isin(takes)).select("i", names[F.col("comp")].cast("long").alias("j"), "v")
        out, many = (chosen if out is None else out.union(chosen)), many + len(takes)
        gone = covered.where(F.col("comp").isin(takes)).select("i").union(seeds.where(F.col("comp").isin(takes)).select("i")).distinct()
        unused = settle(unused.join(gone, "i", "left_anti"))
        if unused.count() == left:
            break
    if out is None:
        n = points.count()
        return points.select("i", F.lit(0).cast("long").alias("j"), F.lit(1.0 / max(1, n)).alias("v"))
    return settle(out)


def factorise_tables(matrix: DataFrame, steps: int = 5, most: int = 200, stop: float = 1e-12, rate: float = 2000.0, target: float = 5.0, seed: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """(F, G, error) of a matrix of any size, as tables: a start, G solved for it, then the steps of ``descend_on_driver``."""
    m = settle(matrix.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w"))
    turned = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    powered = lambda by, x: power_times(by, x.select("i", F.col("j").alias("comp"), "v"), steps).select("i", F.col("comp").alias("j"), "v")
    f = start_tables(m, steps, seed)
    g = settle(transpose(columns_solved(small_product(f, f), powered(turned, f), True)))

    def miss(f: DataFrame, g: DataFrame) -> float:
        gt = settle(transpose(g))
        return float((small_product(f, f) * small_product(gt, gt)).sum() - 2 * inner(f, powered(m, gt)).first()[0])

    gamma, delta, now = f, g, miss(f, g)
    for _ in range(most):
        if rate < 1e-9:
            break
        tried = [settle(x) for x in gradient_step(m, gamma, delta, steps, rate)]
        f2, g2 = (settle(normalised(x)) for x in tried)
        drop = now - miss(f2, g2)
        if 0 <= drop <= target:
            (gamma, delta), f, g, now = tried, f2, g2, now - drop
            if drop < stop:
                break
        else:
            rate *= 0.5 if drop < 0 else target / drop
    return f, g, now


def boosted_tables(matrix: DataFrame, runs: int = 6, steps: int = 5, boost: int = 5, seed: int = 1, **options) -> DataFrame:
    """G of an ensemble over tables: components of all runs by components of all runs come to the driver, factors do not."""
    single, offset, fs, gs = [factorise_tables(matrix, steps, seed=seed + k, **options) for k in range(runs)], 0, None, None
    for f, g, _ in single:
        fk, gk = f.withColumn("j", F.col("j") + offset), g.withColumn("i", F.col("i") + offset)
        fs, gs = (fk, gk) if fs is None else (fs.union(fk), gs.union(gk))
        offset += 1 + f.agg(F.max("j")).first()[0]
    fs, gs = settle(normalised(fs)), settle(normalised(gs))
    small = columns_to_one(small_product(transpose(gs), fs))
    _, sg, _ = min((projected(small, steps=2, seed=seed + k) for k in range(boost)), key=lambda x: x[2])
    cells = [(int(i), int(j), float(sg[i, j])) for i, j in zip(*np.nonzero(sg), strict=True)]
    return settle(product(matrix.sparkSession.createDataFrame(cells, "i long, j long, v double"), gs))


def labels_of(spark, ids: list, g: np.ndarray) -> DataFrame:
    """(i, label): each point's largest component."""
    return spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids, g.argmax(0), strict=True)], "i long, label int")
