"""Bottom-up merging of regions across scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle
from .filters import gaussian, separable
from .neighbours import adjacency, least_labels
from .order import cut_off
from .stats import merge_cost, sufficient


def rename(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Replace the ids of a column by their labels, where they have one."""
    to = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_label", column)).drop("_node", "_label")


def merge_round(edges: DataFrame, costs: DataFrame, remove: int) -> tuple[DataFrame, DataFrame, float | None]:
    """(labels, edges left, cut-off): all edges up to the remove-th least cost merge, ties too; what is left keeps its repeats."""
    cut = cut_off(costs, "error", remove)
    labels = settle(least_labels(costs.where(F.col("error") <= cut)) if cut is not None else costs.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0))
    left = rename(rename(costs.where(F.col("error") > cut).select("a", "b") if cut is not None else edges, labels, "a"), labels, "b")
    return labels, left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), cut


def multiscale(pixels: DataFrame, pixel_region: DataFrame, rows: int, cols: int, highest: float, m: float = 20.0, sigma: float = 3.0, least_count: int = 1) -> DataFrame:
    """(scale, rep, atom): the groups of atoms that each scale makes. pixels (r, c, band, v) are blurred more at each scale."""
    kernel = gaussian(sigma)
    edges = settle(adjacency(pixel_region))
    owner = settle(pixel_region.select(F.col("region").alias("atom"), F.col("region").alias("rep")).distinct())
    living = owner.count()
    size, out = (rows * cols / max(1, living)) ** 0.5, None
    while size < highest and living > least_count:
        pixels = settle(separable(pixels, kernel, kernel, rows, cols))
        size += sigma
        remove = min(living - int(rows * cols / size**2), edges.count())
        if remove <= 0:
            if not edges.count():
                break
            continue
        current = pixel_region.join(owner, pixel_region["region"] == owner["atom"]).select("r", "c", F.col("rep").alias("region"))
        costs = settle(merge_cost(edges, settle(sufficient(pixels, current)), m, size))
        labels, left, _ = merge_round(edges, costs, remove)
        edges = settle(left)
        grown = labels.where("node <> label").select(F.col("label").alias("rep")).distinct()
        owner = settle(rename(owner, labels, "rep").select("atom", "rep"))
        new = owner.join(grown, "rep", "left_semi").select(F.lit(float(size)).alias("scale"), "rep", "atom")
        out = new if out is None else out.union(new)
        living = owner.select("rep").distinct().count()
    return out if out is not None else owner.select(F.lit(0.0).alias("scale"), "rep", "atom").limit(0)
