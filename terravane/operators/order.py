"""Numbering and running sums over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of ``order``, each row with the number of its range; written down, as ranges are sampled anew each time."""
    return settle(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each row."""
    ranged = _ranged(df, order)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))  # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(heads, "_range").withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_range", "_before")


def dense_index(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """Adds 0..n-1 in order of distinct rows of ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")


def cut_off(df: DataFrame, value: str, n: int) -> float | None:
    """The n-th smallest value (the largest if there are fewer), ties counted as rows.

    Ranges of the value are counted first, so that only the range that holds it is put in order.
    """
    ranged = _ranged(df.select(value).where(F.col(value).isNotNull()), [value])
    counts = sorted(ranged.groupBy("_range").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect())  # a row a range
    for r in counts:
        if n <= r.n and r.low < r.high:
            return ranged.where(F.col("_range") == r["_range"]).orderBy(value).limit(n).agg(F.max(value)).first()[0]
        if n <= r.n:
            return r.low
        n -= r.n
    return counts[-1].high if counts else None
