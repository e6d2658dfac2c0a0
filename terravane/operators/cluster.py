"""Clustering of descriptors: k-means, spectral, and labels from factors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from . import graph
from .graph import distance2


def lloyd_step(points: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (i, k, d2) by the nearest of the centres (k, f), ties to the least k, and the centres' new means.

    Centres are few (one row a cluster), so they travel with the rows as one array.
    """
    every = centres.agg(F.sort_array(F.collect_list(F.struct("k", "f"))).alias("centres"))
    near = F.array_min(F.transform("centres", lambda x: F.struct(distance2(F.col("f"), x["f"]).alias("d2"), x["k"].alias("k"))))
    assigned = points.crossJoin(F.broadcast(every)).select("i", "f", near.alias("b")).select("i", "f", "b.k", "b.d2")  # one row of centres
    cells = assigned.select("k", F.posexplode("f").alias("at", "x")).groupBy("k", "at").agg(F.avg("x").alias("x"))
    means = cells.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("f"))
    return assigned.select("i", "k", "d2"), means


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = 1000) -> DataFrame:
    """(i, label): rounds from given centres (k, f) until no label changes, or ``rounds`` of them; a centre without points stays."""
    centres, last = settle(centres.select("k", "f")), None
    while rounds:
        rounds -= 1
        assigned, means = lloyd_step(points, centres)
        assigned = settle(assigned)
        if last is not None and assigned.join(last, "i").where(F.col("k") != F.col("label")).isEmpty():
            break
        last = assigned.select("i", F.col("k").alias("label"))
        centres = settle(centres.join(means.withColumnRenamed("f", "_f"), "k", "left").select("k", F.coalesce("_f", "f").alias("f")))
    return assigned.select("i", F.col("k").alias("label"))


def kmeans(points: DataFrame, k: int, rounds: int = 1000, starts: int = 10, seed: int = 1) -> DataFrame:
    """(i, label): the best of several seeded runs."""
    rows = settle(points.select("i", array_to_vector("f").alias("features")))
    models = [KMeans(k=k, maxIter=rounds, seed=seed + s).fit(rows) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("i", F.col("prediction").alias("label"))


def spectral(matrix: DataFrame, k: int, most: int = 4000, seed: int = 1) -> DataFrame:
    """(i, label): k-means over the leading eigenvectors of a symmetric weight matrix (i, j, w).

    Up to ``most`` rows these are found on the driver, beyond that by subspace iteration over the table.
    """
    spark = matrix.sparkSession
    ids = [r.i for r in matrix.select("i").distinct().orderBy("i").limit(most + 1).collect()]
    if len(ids) > most:
        rows = graph.leading(matrix, k, tolerance=1e-6, seed=seed)[1]
        size = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
        return kmeans(rows.select("i", F.transform("f", lambda x: x / F.greatest(size, F.lit(1e-300))).alias("f")), k, seed=seed)
    at = {x: n for n, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in matrix.toLocalIterator():
        w[at[r.i], at[r.j]] = r.w
    d = 1 / np.sqrt(np.maximum(w.sum(0), 1e-300))
    vectors = np.linalg.eigh(d[:, None] * w * d[None])[1][:, -k:]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "i long, f array<double>")
    return kmeans(rows, k, seed=seed)


def argmax_labels(g: DataFrame) -> DataFrame:
    """(i, label): for each point the component of its largest factor, the first on ties; g is (comp, i, v)."""
    best = g.groupBy("i").agg(F.min(F.struct((-F.col("v")).alias("v"), "comp")).alias("b"))
    return best.select("i", F.col("b.comp").alias("label"))
