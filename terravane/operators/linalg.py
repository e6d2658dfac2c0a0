"""Matrices as rows (i, j, v): sums along axes, products, and the error of a factorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axis_sum(matrix: DataFrame, axis: int) -> DataFrame:
    """(index, total): axis 0 sums each column, axis 1 each row."""
    return matrix.groupBy(F.col("j" if axis == 0 else "i").alias("index")).agg(F.sum("v").alias("total"))


def axis_sum_product(a: DataFrame, b: DataFrame, axis: int) -> DataFrame:
    """Sums of a * b along an axis."""
    return axis_sum(a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")), axis)


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b, by an equal-key join on the inner index and partial sums."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (total): the sum of a * b."""
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("total"))


def change(new: DataFrame, old: DataFrame, gradient: DataFrame) -> DataFrame:
    """One row (total): the sum of (new - old) * gradient, what a step along the gradient has come to."""
    moved = new.select("i", "j", "v").union(old.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return inner(moved, gradient)


def error_term(powered_g: DataFrame, f: DataFrame, g: DataFrame) -> DataFrame:
    """(error): ||D - F G||**2 less ||D||**2, from F (n x r), G (r x n) and D G' (n x r), through r x r products alone."""
    ff, gg = product(transpose(f), f), product(g, transpose(g))
    return inner(ff, gg).withColumnRenamed("total", "a").crossJoin(inner(f, powered_g).withColumnRenamed("total", "b")).select((F.col("a") - 2 * F.col("b")).alias("error"))  # one row each


def from_rows(rows: DataFrame) -> DataFrame:
    """A matrix of (i, f array): one entry a component, zeros left out."""
    return rows.select("i", F.posexplode("f").alias("j", "v")).where("v <> 0")


def from_triples(spark: SparkSession, data, i, j) -> DataFrame:
    """A matrix of parallel lists; entries at one place add up."""
    rows = spark.createDataFrame([(int(a), int(b), float(x)) for a, b, x in zip(i, j, data, strict=True)], "i long, j long, v double")
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def from_compressed(spark: SparkSession, data, indices, starts) -> DataFrame:
    """A matrix of compressed rows: row i holds entries starts[i] to starts[i + 1]."""
    i = [row for row, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) for _ in range(a, b)]
    return from_triples(spark, data, i, indices)
