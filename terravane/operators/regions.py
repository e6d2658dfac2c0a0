"""Access to partitions of pixels (r, c, region) and to regions that are sets of atoms (region, atom)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import dense_index


def inverted_index(pixel_region: DataFrame) -> DataFrame:
    """(region, n, pixels): every region's pixels in raster order."""
    return pixel_region.groupBy("region").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("pixels"))


def boxes(pixel_region: DataFrame) -> DataFrame:
    return pixel_region.groupBy("region").agg(F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right"))


def at_location(pixel_region: DataFrame, r: int, c: int) -> DataFrame:
    """The atomic region of a pixel; no row where there is none."""
    return pixel_region.where((F.col("r") == r) & (F.col("c") == c)).select("r", "c", "region")


def compounds_at(pixel_region: DataFrame, region_atoms: DataFrame, r: int, c: int) -> DataFrame:
    """All compound regions that hold the atom of a pixel."""
    atom = at_location(pixel_region, r, c).select(F.col("region").alias("atom"))
    return region_atoms.join(F.broadcast(atom), "atom", "left_semi").select("region").distinct()  # one row at most


def pixels_of(pixel_region: DataFrame, region_atoms: DataFrame) -> DataFrame:
    """(region, r, c) of compound regions; a pixel shows once for each region that holds its atom."""
    return region_atoms.join(pixel_region.withColumnRenamed("region", "atom"), "atom").select("region", "r", "c")


def fetch(pixels: DataFrame, pixel_region: DataFrame, regions: list[int]) -> DataFrame:
    """The pixels of some regions with their places in each region's box: a tile, its outside left out."""
    mine = pixel_region.where(F.col("region").isin(regions))
    held = pixels.join(mine, ["r", "c"]).join(boxes(mine), "region")
    keep = [x for x in pixels.columns if x not in ("r", "c")]
    return held.select("region", "r", "c", (F.col("r") - F.col("top")).alias("tile_r"), (F.col("c") - F.col("left")).alias("tile_c"), *keep)


def assign(pixels: DataFrame, pixel_region: DataFrame, values: DataFrame) -> DataFrame:
    """A raster with the regions of values (region, new) overwritten."""
    hit = pixel_region.join(values, "region").select("r", "c", "new")
    return pixels.join(hit, ["r", "c"], "left").select("r", "c", F.coalesce("new", "v").alias("v"))


def compose(region_atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """(region, atom) of the map whose regions are clusters (region, cluster) of the old one's; shared atoms count once."""
    return region_atoms.join(mapping, "region").select(F.col("cluster").alias("region"), "atom").distinct()


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(region, other, n): how many atoms two maps' regions share, where they share any."""
    return left.join(right.select(F.col("region").alias("other"), "atom"), "atom").groupBy("region", "other").agg(F.count("*").alias("n"))


def submap(region_atoms: DataFrame, keys: DataFrame) -> DataFrame:
    return region_atoms.join(keys.select("region").distinct(), "region", "left_semi")


def export(region_atoms: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(region, atoms[, extra columns]): the raw form; extra holds columns that a function of (map, key) has made."""
    raw = region_atoms.groupBy("region").agg(F.array_sort(F.collect_set("atom")).alias("atoms"))
    return raw if extra is None else raw.join(extra, "region", "left")


def from_raw(raw: DataFrame) -> DataFrame:
    """(region, atom) of (region, atoms)."""
    return raw.select("region", F.explode("atoms").alias("atom"))


def extra(data: DataFrame, name: str) -> DataFrame:
    """One named array of a map column ``extra``; regions without it are left out."""
    return data.select("region", F.try_element_at("extra", F.lit(name)).alias("value")).where("value is not null")


def value_at(pixels: DataFrame, r: int, c: int) -> DataFrame:
    """All bands of one pixel."""
    return pixels.where((F.col("r") == r) & (F.col("c") == c))


def for_raster(pixel_region: DataFrame, raster: DataFrame) -> DataFrame:
    """The same regions over another raster: its values with the region of each pixel."""
    return raster.join(pixel_region, ["r", "c"])


def crop(pixels: DataFrame, pixel_region: DataFrame, region: int) -> DataFrame:
    """(tile_r, tile_c, values): the box of a region, with zeros in place of the pixels outside it; values are its columns but r and c."""
    keep = [x for x in pixels.columns if x not in ("r", "c")]
    box = boxes(pixel_region.where(F.col("region") == region))
    cells = box.select("top", "left", F.explode(F.sequence("top", "bottom")).alias("r"), "right").select("top", "left", "r", F.explode(F.sequence("left", "right")).alias("c"))
    mine = fetch(pixels, pixel_region, [region]).select("r", "c", *keep)
    return cells.join(mine, ["r", "c"], "left").select((F.col("r") - F.col("top")).alias("tile_r"), (F.col("c") - F.col("left")).alias("tile_c"), *[F.coalesce(k, F.lit(0).cast(pixels.schema[k].dataType)).alias(k) for k in keep])


def indexed(keys: DataFrame, order_by: list[str]) -> DataFrame:
    """Keys with their dense index 0..n-1: both ways between a region's key and its index."""
    return dense_index(keys, order_by)


def histogram(pixel_region: DataFrame, least: int = 1) -> DataFrame:
    """(region, n, active): pixels of each region, and whether there are ``least`` or more."""
    return pixel_region.groupBy("region").agg(F.count("*").alias("n")).withColumn("active", F.col("n") >= least)


def living(renames: DataFrame) -> DataFrame:
    """(active): how many regions of (node, label) are still their own name."""
    return renames.agg(F.count_if(F.col("node") == F.col("label")).alias("active"))
