"""Files of region maps: one Parquet folder an entity with a row of metadata, text rasters, and colour pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = ("runs", "nodes", "node_atoms", "labels")


def write_map(path: str, compression: str = "snappy", meta: dict | None = None, **entities: DataFrame) -> None:
    """Write the entities (of ENTITIES) and the metadata, such as image_shape and run times, below path."""
    if unknown := set(entities) - set(ENTITIES):
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    for name, df in entities.items():
        by = ["scale"] if name == "labels" and "scale" in df.columns else []
        df.write.mode("overwrite").option("compression", compression).partitionBy(*by).parquet(f"{path}/{name}")
    spark = next(iter(entities.values())).sparkSession
    rows = [(k, str(v)) for k, v in sorted((meta or {}).items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_map(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One entity; only the columns that a query uses are read, and labels are pruned by scale."""
    if name not in (*ENTITIES, "meta"):
        raise ValueError(f"unknown entity: {name}")
    return spark.read.parquet(f"{path}/{name}")


def raster_lines(pixels: DataFrame, value: str, separator: str = ", ") -> DataFrame:
    """(r, line): the values of each raster row in column order, as text."""
    cells = F.array_sort(F.collect_list(F.struct("c", F.col(value).cast("string").alias("t"))))
    return pixels.groupBy("r").agg(F.array_join(F.transform(cells, lambda x: x["t"]), separator).alias("line"))


def feature_lines(features: DataFrame, separator: str = ", ", missing: str = "<Not in file>") -> DataFrame:
    """(region, line): one text line of numbers a region; a region without features says so."""
    line = F.array_join(F.transform("f", lambda x: x.cast("string")), separator)
    return features.select("region", F.coalesce(line, F.lit(missing)).alias("line"))


def colours(region: str = "region") -> F.Column:
    """A fixed colour for each region, as 'red green blue'."""
    h = F.pmod(F.col(region).cast("long"), F.lit(1 << 31)) * 2654435761
    part = lambda k: F.pmod(F.shiftright(h, k), F.lit(256)).cast("string")
    return F.concat_ws(" ", part(0), part(8), part(16))


def picture_lines(pixel_region: DataFrame) -> DataFrame:
    """(r, line): a raster row of an ASCII colour picture."""
    return raster_lines(pixel_region.withColumn("colour", colours()), "colour", " ")


def write_picture(pixel_region: DataFrame, path: str) -> None:
    """A text picture (P3): header, then one line a raster row, in order."""
    rows, cols = pixel_region.agg(F.max("r") + 1, F.max("c") + 1).first()
    head = pixel_region.sparkSession.createDataFrame([(-1, f"P3\n{cols} {rows}\n255")], "r long, line string")
    head.union(picture_lines(pixel_region)).repartitionByRange(1, "r").sortWithinPartitions("r").select("line").write.mode("overwrite").text(path)
