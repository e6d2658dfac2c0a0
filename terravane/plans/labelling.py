"""Pipelines: images to hierarchies of superpixels, and hierarchies to label maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, graph, hierarchy, merge, nmf, slic, stats
from ..sources.tables import settle


@dataclass(frozen=True)
class SlicParams:
    m_base: float = 20.0
    m_scale: float = 1.0
    sigma: float = 3.0
    most_rounds: int = 1000
    least_size: int = 25
    least_count: int = 1
    runs: int = 1


@dataclass(frozen=True)
class GraphParams:
    knn: int = 128
    norm: str = "local"
    smoothing: str | float = "intrinsic dimensionality"
    steps: int | None = None
    nmf: dict = field(default_factory=dict)  # tries, most, stop
    guesses: int = 1
    boost_runs: int = 6
    boosts: int = 5


def hierarchical_superpixels(pixels: DataFrame, rows: int, cols: int, base: int, highest: float, params: SlicParams = SlicParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixel_region, nodes, node_atoms) of pixels (r, c, v array): superpixels of about base x base, merged up to tiles of ``highest``."""
    parts = settle(slic.slic(pixels, rows, cols, base, params.m_base, params.most_rounds, params.least_size, runs=params.runs))
    flat = pixels.select("r", "c", F.posexplode("v").alias("band", "v"))
    merges = settle(merge.multiscale(flat, parts, rows, cols, highest, params.m_scale, params.sigma, params.least_count))
    atoms = parts.select(F.col("region").alias("atom")).distinct()
    return parts, settle(hierarchy.build(merges, atoms)), settle(hierarchy.members(merges, atoms))


def descriptors(pixels: DataFrame, pixel_region: DataFrame, space: str | Callable = "histogram_moments", **options) -> DataFrame:
    """(i, f) of regions over pixels (r, c, band, v): 'histogram_moments', 'gabor_filters' or 'quadtree', missing entries 0;
    or a function (pixels, pixel_region, **options) to (region, at, value), whose values are put in order of ``at``."""
    if callable(space):
        cells = space(pixels, pixel_region, **options)
    elif space == "histogram_moments":
        values = pixels.join(pixel_region, ["r", "c"]).select("region", "band", "v")
        cells = stats.moments(values, options.get("count", 5)).select("region", F.struct("moment", "band").alias("at"), "value")
    elif space == "quadtree":
        levels = options.get("levels", 3)
        names = [""]
        for _ in range(levels - 1):
            names += [n + q for n in names for q in "1234" if len(n + q) <= levels - 1 and n + q not in names]
        found = stats.quadtree(pixels, pixel_region, levels)
        every = found.select("band").distinct().withColumn("node", F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(names)])))
        grid = found.select("region").distinct().join(F.broadcast(every))  # nodes of a tree of fixed depth
        cells = grid.join(found, ["region", "node", "band"], "left").select("region", F.struct("node", "band").alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"))
    elif space == "gabor_filters":
        cells = stats.gabor(pixels, pixel_region, **options).select("region", F.struct("octave", "direction", "band", "part").alias("at"), F.col("energy").alias("value"))
    else:
        raise ValueError(f"unknown feature space: {space}")
    return cells.groupBy(F.col("region").alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("f"))


def similarity(points: DataFrame, params: GraphParams = GraphParams()) -> tuple[DataFrame, DataFrame, int]:
    """(weights, diffusion matrix, steps) of descriptors (i, f)."""
    knn = settle(graph.nearest(points, params.knn))
    scaled = settle(graph.normalised(knn, params.norm))
    factor = graph.intrinsic(scaled)[0] if isinstance(params.smoothing, str) else float(params.smoothing)
    weight = settle(graph.weights(scaled, factor))
    steps = params.steps or graph.estimate_steps(weight, nmf.MOST)
    return weight, settle(graph.diffusion(weight)), steps


def label(points: DataFrame, method: str = "kmeans", params: GraphParams = GraphParams(), k: int | None = None, seed: int = 1) -> DataFrame:
    """(i, label) by kmeans, spectral, NMF or NMF-boosted; the number of clusters comes from the graph where it is not given.

    Graphs of up to nmf.MOST rows are factorised on the driver, larger ones as tables.
    """
    if method not in ("kmeans", "spectral", "NMF", "NMF-boosted"):
        raise ValueError(f"unknown method: {method}")
    if method == "kmeans" and k:
        return cluster.kmeans(points, k, seed=seed)
    weight, matrix, steps = similarity(points, params)
    if method == "spectral" and k:
        return cluster.spectral(weight, k, seed=seed)
    nmf_options, large = params.nmf, points.count() > nmf.MOST
    tables = {x: nmf_options[x] for x in ("most", "stop") if x in nmf_options}
    if large and method in ("NMF", "NMF-boosted"):
        g = nmf.factorise_tables(matrix, steps, seed=seed, **tables)[1] if method == "NMF" else nmf.boosted_tables(matrix, steps=steps, seed=seed, runs=params.boost_runs, boost=params.boosts, **tables)
        return cluster.argmax_labels(g.select(F.col("i").alias("comp"), F.col("j").alias("i"), "v"))
    if large:
        k = 1 + nmf.start_tables(matrix, steps, seed).agg(F.max("j")).first()[0]
    else:
        ids, dense = nmf.collected(matrix)
    if method in ("kmeans", "spectral"):
        k = k or nmf.start(dense, steps, nmf_options.get("tries", 25), seed)[0].shape[1]
        return cluster.kmeans(points, k, seed=seed) if method == "kmeans" else cluster.spectral(weight, k, seed=seed)
    if method == "NMF":
        g = nmf.projected(dense, steps=steps, seed=seed, guesses=params.guesses, **nmf_options)[1]
    else:
        g = nmf.boosted(dense, runs=params.boost_runs, steps=steps, boost=params.boosts, seed=seed, guesses=params.guesses, **nmf_options)[1]
    return nmf.labels_of(points.sparkSession, ids, g)


def next_scale(spread: Callable[[int], int], n: int, a: int) -> int | None:
    """The next of n scales after index a, by bisection: the first at which every region spans two labels or more, or the last.

    spread(k) is the least number of labels in a region at scale k. None where fewer than two scales are left to choose from.
    """
    low, high, tested = a + 1, n - 1, False
    while low + 1 < high:
        tested, mid = True, (low + high) // 2
        low, high = (low, mid) if spread(mid) >= 2 else (mid, high)
    return high if tested else None


def label_stack(nodes: DataFrame, node_atoms: DataFrame, describe, scales: list[float] | None = None, **options) -> DataFrame:
    """(scale, atom, label) at given scales, or from the smallest on at those that bisection finds.

    describe(region_atoms) gives descriptors (i, f) of a map's regions.
    """

    def at(scale: float) -> DataFrame:
        atoms = hierarchy.cut_atoms(nodes, node_atoms, scale)
        labels = label(describe(atoms), **options)
        return settle(atoms.join(labels, F.col("region") == F.col("i")).select(F.lit(float(scale)).alias("scale"), "atom", "label"))

    if scales is not None:
        out = [at(s) for s in sorted(scales)]
    else:
        known = sorted(r.scale for r in hierarchy.scales(nodes).collect())
        out, k = [], 0
        while k is not None:
            current = at(known[k])
            out.append(current)

            def spread(j: int, current: DataFrame = current) -> int:
                atoms = hierarchy.cut_atoms(nodes, node_atoms, known[j])
                return stats.least_spread(atoms.join(current, "atom").select("region", "label")).first()[0] or 0

            k = next_scale(spread, len(known), k)
    stack = out[0]
    for more in out[1:]:
        stack = stack.union(more)
    return stack
