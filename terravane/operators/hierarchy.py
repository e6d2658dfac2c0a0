"""Forests of regions as nodes (node, parent, scale) and node_atoms (node, atom), and stacks of labels (scale, atom, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle


def scales(nodes: DataFrame) -> DataFrame:
    return nodes.select("scale").distinct()


def nearest_scale(nodes: DataFrame, value: float) -> DataFrame:
    """The scale nearest to a value, the lower one on ties."""
    return scales(nodes).agg(F.min(F.struct(F.abs(F.col("scale") - value).alias("d"), "scale"))["scale"].alias("scale"))


def cut(nodes: DataFrame, scale: float) -> DataFrame:
    """(node): the first nodes from the roots down that are under a scale, or leaves. As scales never fall on the way up, a node
    is one of them if it is under the scale (or a leaf) and its parent is not."""
    parents = nodes.select(F.col("node").alias("_p"), F.col("scale").alias("_above"))
    inner = nodes.where("parent is not null").select(F.col("parent").alias("_q")).distinct()
    rows = nodes.join(parents, F.col("parent") == F.col("_p"), "left").join(inner, F.col("node") == F.col("_q"), "left")
    return rows.where(((F.col("scale") < scale) | F.col("_q").isNull()) & (F.col("_p").isNull() | (F.col("_above") >= scale))).select("node")


def cut_atoms(nodes: DataFrame, node_atoms: DataFrame, scale: float) -> DataFrame:
    """(region, atom) of the map at a scale."""
    return node_atoms.join(cut(nodes, scale), "node").select(F.col("node").alias("region"), "atom")


def _ways(merges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(scale, atom, node): all nodes that hold an atom; a merged group is (scale, rep), an atom itself is a leaf at scale 0."""
    name = F.concat_ws(":", F.col("scale").cast("string"), F.col("rep").cast("string"))
    return merges.select("scale", "atom", name.alias("node")).union(atoms.select(F.lit(0.0), "atom", F.concat(F.lit("atom:"), F.col("atom").cast("string"))))


def build(merges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(node, parent, scale) from merges (scale, rep, atom): groups of atoms that became one at a scale.

    An atom's nodes in order of scale are its way up, so a node's parent is the next one on the way of its atoms.
    """
    up = F.lead("node").over(Window.partitionBy("atom").orderBy("scale", "node"))
    return _ways(merges, atoms).withColumn("parent", up).groupBy("node").agg(F.min("parent").alias("parent"), F.first("scale").alias("scale"))


def members(merges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(node, atom) of the same forest."""
    return _ways(merges, atoms).select("node", "atom")


def from_stack(stack: DataFrame, levels: list[float]) -> DataFrame:
    """(node, parent, scale, n) of labels at several scales, coarse ones first: a node is a distinct path of labels, as in a roll-up."""
    one = stack.groupBy("atom").pivot("scale", levels).agg(F.min("label"))
    names = [one.columns[1 + k] for k in range(len(levels))]
    text = [F.col(f"`{c}`").cast("string") for c in names]
    paths = F.array(*[F.struct(F.concat_ws("/", *text[: k + 1]).alias("node"), (F.concat_ws("/", *text[:k]) if k else F.lit(None).cast("string")).alias("parent"), F.lit(float(levels[k])).alias("scale")) for k in range(len(levels))])
    return one.withColumn("p", F.explode(paths)).groupBy("p.node", "p.parent", "p.scale").agg(F.count("*").alias("n"))


def roots_of(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that no other key is an ancestor of. Every round doubles how far up each node has looked, until all reach a key or the top."""
    named = keys.select(F.col("node").alias("_k")).distinct()
    way = nodes.select("node", F.col("parent").alias("up")).join(named, F.col("up") == F.col("_k"), "left")
    way = settle(way.select("node", F.when(F.col("_k").isNull(), F.col("up")).alias("up"), F.col("_k").isNotNull().alias("under")))
    while not way.where("up is not null").isEmpty():
        above = way.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("under").alias("_under"))
        way = settle(way.join(above, F.col("up") == F.col("_n"), "left").select("node", F.col("_up").alias("up"), (F.col("under") | F.coalesce("_under", F.lit(False))).alias("under")))
    return keys.select("node").join(way.where("under").select("node"), "node", "left_anti")


def indicator(nodes: DataFrame, node_atoms: DataFrame, pixel_region: DataFrame, scale: float) -> DataFrame:
    """(r, c, region): every pixel's region at a scale."""
    atoms = cut_atoms(nodes, node_atoms, scale)
    return pixel_region.select("r", "c", F.col("region").alias("atom")).join(atoms, "atom").select("r", "c", "region")
