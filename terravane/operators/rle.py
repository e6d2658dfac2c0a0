"""Run-length encoding of raster lines; runs end where a line ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(lines: DataFrame) -> DataFrame:
    """(line, run_no, run_length, value) of (line, pos, value)."""
    by_line = Window.partitionBy("line").orderBy("pos")
    new = F.when(F.lag("value").over(by_line).eqNullSafe(F.col("value")) & (F.col("pos") > F.min("pos").over(Window.partitionBy("line"))), 0).otherwise(1)
    numbered = lines.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("line", "run_no").agg(F.count("*").alias("run_length"), F.first("value").alias("value"))


def decode(runs: DataFrame) -> DataFrame:
    """(line, pos, value) of (line, run_no, run_length, value)."""
    end = F.sum("run_length").over(Window.partitionBy("line").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_end", end).select("line", F.explode(F.sequence(F.col("_end") - F.col("run_length"), F.col("_end") - 1)).alias("pos"), "value")


def decode_raster(runs: DataFrame, rows: int, cols: int) -> DataFrame:
    """(r, c, value) of (run_no, run_length, value) in raster order; runs that do not fill the raster exactly raise when it is read."""
    upto = F.sum("run_length").over(Window.orderBy("run_no"))
    total = F.sum("run_length").over(Window.partitionBy())
    whole = F.lit(f"runs must be positive and come to {rows} x {cols} pixels")
    sound = (F.col("run_length") > 0) & (F.col("_total") == rows * cols) & F.col("value").isNotNull()
    placed = runs.withColumn("_end", upto).withColumn("_total", total).withColumn("_end", F.when(sound, F.col("_end")).otherwise(F.raise_error(whole).cast("long")))
    cells = placed.select(F.explode(F.sequence(F.col("_end") - F.col("run_length"), F.col("_end") - 1)).alias("at"), "value")
    return cells.select(F.floor(F.col("at") / cols).alias("r"), F.pmod("at", F.lit(cols)).alias("c"), "value")
