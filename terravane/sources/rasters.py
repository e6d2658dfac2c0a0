"""Pixel tables: rasters held as rows (r, c[, band], v), partitions of pixels, features, and image files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

BANDS, TILE = 4, 8


def line_raster(spark: SparkSession, folder: str) -> DataFrame:
    """One band: a row of pixels for each vector."""
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))
    return rows.select("r", "c", F.col("v").cast("double").alias("v"))


def banded_raster(spark: SparkSession, folder: str) -> DataFrame:
    """The same values as pixels of four bands."""
    return line_raster(spark, folder).select("r", F.floor(F.col("c") / BANDS).cast("int").alias("c"), F.pmod("c", F.lit(BANDS)).alias("band"), "v")


def label_regions(spark: SparkSession, folder: str) -> DataFrame:
    """(r, c, region): the partition of line_raster by the vectors' labels."""
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "_v"), "label")
    return rows.select("r", "c", F.col("label").cast("long").alias("region"))


def tile_of(r: str = "r", c: str = "c") -> F.Column:
    return (F.floor(F.col(r) / TILE) * TILE + F.floor(F.col(c) / TILE)).cast("long")


def tile_regions(spark: SparkSession, folder: str) -> DataFrame:
    """(r, c, region): the partition of line_raster into square tiles."""
    return line_raster(spark, folder).select("r", "c", tile_of().alias("region"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(i, f): one descriptor a region."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("f"))


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line, pos, value): the event types of each user in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, folder, "events").select(F.col("user_id").alias("line"), (F.row_number().over(order) - 1).alias("pos"), F.col("event_type").alias("value"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, r, c, band, v in 0..1) of image files: a gray image gives three equal bands, an alpha band is left out."""
    raw = spark.read.format("image").load(path).select("image.*")

    def run(batches):
        for pdf in batches:
            for x in pdf.itertuples():
                if x.nChannels < 1:  # a file that is no image
                    continue
                cells = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels)
                cells = np.repeat(cells, 3, 2) if x.nChannels == 1 else cells[:, :, 2::-1]  # the reader stores blue, green, red
                for top in range(0, x.height, 256):
                    part = cells[top : top + 256]
                    r, c, band = (v.ravel() for v in np.indices(part.shape))
                    yield pd.DataFrame({"origin": x.origin, "r": r + top, "c": c, "band": band, "v": part.ravel() / 255.0})

    return raw.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, r long, c int, band int, v double")
