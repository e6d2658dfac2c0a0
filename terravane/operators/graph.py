"""Nearest neighbours, similarity weights and diffusion on sparse matrices (i, j, w)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

BLOCK = 2048


def nearest(points: DataFrame, k: int, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, rank, d2): the k nearest points (i, f[, offset]) of every query, itself included; ties go to the least j.

    With offsets, nearness is point offset + distance + query offset and d2 is its square. Points and queries are packed into
    blocks; every query block meets every point block in a task of its own, which keeps k rows a query.
    """
    queries = points if queries is None else queries
    many = max(1, math.ceil(points.count() / block))
    packed = lambda df, n, name: _blocks(df, n).select(F.col("block").alias(f"{name}_block"), F.struct("i", "f", "offset").alias(name))
    left, right = packed(queries, max(1, math.ceil(queries.count() / block)), "query"), packed(points, many, "point")
    tasks = left.withColumn("point_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))
    pairs = tasks.join(right, "point_block").select("query", "point")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch["query"].to_pylist(), batch["point"].to_pylist(), strict=True):
                qi, pi = np.array(x["i"]), np.array(y["i"])
                q, p = np.frombuffer(x["f"]).reshape(len(qi), -1), np.frombuffer(y["f"]).reshape(len(pi), -1)
                # Products rank first; the few that may be among the k are measured again by differences, which lose no digits.
                near = np.maximum(0, (q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T)
                near = np.sqrt(near) + np.array(y["offset"])[None]
                take = min(k, len(pi))
                limit = np.partition(near, take - 1, axis=1)[:, take - 1] + 1e-6 * (1 + np.abs(near).max())
                rows, cols = np.nonzero(near <= limit[:, None])
                exact = np.sqrt(((q[rows] - p[cols]) ** 2).sum(1)) + np.array(y["offset"])[cols] + np.array(x["offset"])[rows]
                order = np.lexsort((pi[cols], exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < take
                yield pa.RecordBatch.from_arrays([pa.array(qi[rows[keep]]), pa.array(pi[cols[keep]]), pa.array(exact[keep])], names=["i", "j", "d"])

    found = pairs.mapInArrow(run, "i long, j long, d double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "rank", (F.col("d") * F.col("d")).alias("d2"))


def _blocks(df: DataFrame, many: int) -> DataFrame:
    """Rows packed by hash into ``many`` blocks, some of which may stay empty: ids, one array of all components, offsets."""
    rows = df.select(F.col("i").cast("long").alias("i"), "f", (F.col("offset") if "offset" in df.columns else F.lit(0.0)).cast("double").alias("offset"))
    lists = rows.groupBy(F.pmod(F.xxhash64("i"), F.lit(many)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "f", "offset"))).alias("rows"))

    def pack(batches):
        for batch in batches:
            rows = batch["rows"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["block"], pa.array([[r["i"] for r in x] for x in rows], pa.list_(pa.int64())), pa.array([np.array([r["f"] for r in x]).tobytes() for x in rows], pa.binary()), pa.array([[r["offset"] for r in x] for x in rows], pa.list_(pa.float64()))],
                names=["block", "i", "f", "offset"],
            )

    return lists.mapInArrow(pack, "block long, i array<long>, f binary, offset array<double>")


def normalised(knn: DataFrame, kind: str = "local", given: float = 1.0, back: int = 6) -> DataFrame:
    """Adds f, the squared distance over the normaliser of both ends.

    local: each end's distance to neighbour ``first_good + back`` (0-based), where first_good is the first rank that is over 0
    for all rows, or the last rank that there is; global: the mean squared distance at rank 1; input: given; none: 1.
    """
    d2 = F.col("d2")
    if kind == "none":
        return knn.withColumn("f", d2)
    if kind == "input":
        return knn.withColumn("f", d2 / F.lit(given**2))
    if kind == "global":
        mean = knn.where((F.col("rank") == 2) & (d2 < float("inf"))).agg(F.avg("d2")).first()[0]
        return knn.withColumn("f", d2 / F.lit(mean))
    ranks = knn.groupBy("rank").agg(F.min("d2").alias("least"))
    good, k = ranks.agg(F.coalesce(F.min(F.when(F.col("least") > 0, F.col("rank"))), F.lit(1)), F.max("rank")).first()
    at = good + back if good + back <= k else k
    sigma = knn.where(F.col("rank") == at).select(F.col("i").alias("_i"), F.when(d2 < float("inf"), F.sqrt("d2")).otherwise(0.0).alias("s"))
    both = knn.join(sigma.withColumnRenamed("s", "si"), knn["i"] == F.col("_i")).drop("_i").join(sigma.withColumnRenamed("s", "sj"), knn["j"] == F.col("_i")).drop("_i")
    return both.withColumn("f", d2 / F.nullif(F.col("si") * F.col("sj"), F.lit(0.0))).drop("si", "sj")


def weights(scaled: DataFrame, factor: float) -> DataFrame:
    """(i, j, w): exp(-factor f) of each edge at (i, j) and at (j, i); entries that meet add up, so self loops count twice."""
    w = F.exp(-F.lit(float(factor)) * F.col("f")).alias("w")
    return scaled.select("i", "j", w).union(scaled.select("j", "i", w)).groupBy("i", "j").agg(F.sum("w").alias("w"))


def diffusion(matrix: DataFrame) -> DataFrame:
    """Each column divided by its sum, so columns sum to 1; a column of zeros stays."""
    sums = matrix.groupBy("j").agg(F.sum("w").alias("total"))
    return matrix.join(sums, "j").select("i", "j", F.coalesce(F.col("w") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)).alias("w"))


def times(matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """(i, comp, v): matrix (i, j, w) times columns (i, comp, v)."""
    right = columns.select(F.col("i").alias("j"), "comp", "v")
    return matrix.join(right, "j").groupBy("i", "comp").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def power_times(matrix: DataFrame, columns: DataFrame, steps: float) -> DataFrame:
    """matrix**steps times columns, by products with columns alone; a fraction of a step is left out."""
    for _ in range(int(steps)):
        columns = times(matrix, columns)
    return columns


def dimension_grid(scaled: DataFrame, low: float = -10.0, high: float = 10.0, step: float = 0.25) -> DataFrame:
    """(r, g): the derivative of log sum exp(-f e**-r) over r on a grid; its maximum gives the scale and twice it the dimension."""
    grid = F.explode(F.array(*[F.lit(low + step * x) for x in range(int((high - low) / step))])).alias("r")
    f, r = F.col("f"), F.col("r")
    cells = scaled.where("f is not null").select("f", grid)
    part = F.exp(-f * F.exp(-r))
    return cells.groupBy("r").agg((F.sum(f * F.exp(-r) * part) / F.nullif(F.sum(part), F.lit(0.0))).alias("g"))


def intrinsic(scaled: DataFrame) -> tuple[float, float]:
    """(smoothing factor, intrinsic dimension) from the grid's best point, refined between its neighbours by a finer grid."""
    best = dimension_grid(scaled).orderBy(F.desc("g"), "r").first()
    if best is None or best.g is None:
        return 1.0, 0.0
    fine = dimension_grid(scaled, best.r - 0.25, best.r + 0.25, 0.01).orderBy(F.desc("g"), "r").first()
    return math.exp(-fine.r), 2 * fine.g


def suggested_steps(n: int, dimension: float) -> int:
    return int(dimension * n ** (1 / dimension)) if dimension else 1


def leading(weight: DataFrame, k: int, rounds: int = 300, tolerance: float = 1e-9, seed: int = 1) -> tuple[list[float], DataFrame]:
    """The k largest eigenvalues of D**-1/2 W D**-1/2, and (i, f): each row of their vectors. W (i, j, w) is symmetric, of any size.

    Subspace iteration: the matrix times k columns, which are made orthonormal again through their k x k products; these alone
    come to the driver. The diagonal is raised so that the largest eigenvalues are the largest by size.
    """
    scale = settle(weight.groupBy("i").agg(F.sum("w").alias("d")).select("i", (1 / F.sqrt(F.greatest("d", F.lit(1e-300)))).alias("d")))
    left, right = scale.withColumnRenamed("d", "dl"), scale.select(F.col("i").alias("j"), F.col("d").alias("dr"))
    matrix = settle(weight.join(left, "i").join(right, "j").select("i", "j", (F.col("w") * F.col("dl") * F.col("dr")).alias("w")))
    unit = lambda c: (F.pmod(F.xxhash64("i", F.lit(c), F.lit(seed)), F.lit(1 << 20)) / float(1 << 19)) - 1.0
    x, values = settle(scale.select("i", F.array(*[unit(c) for c in range(k)]).alias("f"))), None

    def grams(rows: DataFrame, other: str) -> np.ndarray:
        def run(batches):
            total = np.zeros((k, k))
            for batch in batches:
                a, b = (np.array(batch[c].to_pylist()).reshape(-1, k) for c in ("f", other))
                total += a.T @ b
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        return sum((np.frombuffer(bytes(r.g)).reshape(k, k) for r in rows.select("f", *({other} - {"f"})).mapInArrow(run, "g binary").toLocalIterator()), np.zeros((k, k)))

    def turned(rows: DataFrame, by: np.ndarray) -> DataFrame:
        rows_of = [F.array(*[F.lit(float(v)) for v in by[:, c]]) for c in range(k)]
        dot = lambda y: F.aggregate(F.zip_with("f", y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return rows.select("i", F.array(*[dot(c) for c in rows_of]).alias("f"))

    for _ in range(rounds):
        x = settle(turned(x, np.linalg.inv(np.linalg.cholesky(grams(x, "f") + 1e-300 * np.eye(k))).T))
        cells = matrix.join(x.withColumnRenamed("i", "j"), "j").select("i", F.posexplode("f").alias("at", "v"), "w").groupBy("i", "at").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        y = settle(cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("y")).join(x, "i"))
        now, basis = np.linalg.eigh((lambda t: (t + t.T) / 2)(grams(y, "y")))
        now, basis = now[::-1], basis[:, ::-1]
        if values is not None and np.abs(now - values).max() < tolerance:
            break
        values = now
        x = settle(y.select("i", F.zip_with("y", "f", lambda p, q: (p + q) / 2).alias("f")))
    else:
        x = settle(turned(x, np.linalg.inv(np.linalg.cholesky(grams(x, "f"))).T))
        return values.tolist(), x
    return now.tolist(), settle(turned(y.select("i", "f"), basis))


def estimate_steps(weight: DataFrame, most: int = 500) -> int:
    """How many diffusion steps let the first eigenvalue under 0.9999 fade.

    The weight matrix is symmetric, so the diffusion matrix has the eigenvalues of D**-1/2 W D**-1/2. Up to ``most`` rows they
    are found on the driver, beyond that by subspace iteration, with more vectors until one of the eigenvalues is under it.
    """
    ids = [r.i for r in weight.select("i").distinct().orderBy("i").limit(most + 1).collect()]
    if len(ids) > most:
        k = 8
        while True:
            below = [x for x in leading(weight, k, tolerance=1e-6)[0] if 0 < x < 0.9999]
            if below or k >= len(ids):
                break
            k = min(2 * k, len(ids))
    else:
        at = {x: n for n, x in enumerate(ids)}
        w = np.zeros((len(ids), len(ids)))
        for r in weight.toLocalIterator():
            w[at[r.i], at[r.j]] = r.w
        d = 1 / np.sqrt(np.maximum(w.sum(0), 1e-300))
        below = [x for x in np.linalg.eigvalsh(d[:, None] * w * d[None])[::-1].tolist() if 0 < x < 0.9999]
    return max(abs(int(math.log(0.95 * below[0]) / math.log(below[0]))), 1) if below else 1


def distance2(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
