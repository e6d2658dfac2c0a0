"""Command line: an image file to a document of superpixels, their hierarchy and their labels.

    python -m terravane.plans.cli IMAGE OUTPUT [--clustering_algorithum kmeans] [--base_scale 2%] [--max_scale 30%] ...
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.scalar import geometric_scales, percent_or_absolute
from ..operators import hierarchy, rle
from ..sources import rasters, sinks
from ..sources.tables import settle
from .labelling import GraphParams, SlicParams, descriptors, hierarchical_superpixels, label_stack

#: The flags with their kinds, defaults and choices.
FLAGS = (
    ("clustering_algorithum", str, "kmeans", ("NMF", "NMF-boosted", "kmeans", "spectral", "none")),
    ("max_scale", str, "30%", None),
    ("m_base", float, 20.0, None),
    ("m_scale", float, 1.0, None),
    ("total_runs", int, 10, None),
    ("SLIC_max_itters", int, 1000, None),
    ("min_cluster_size", int, 25, None),
    ("sigma", float, 3.0, None),
    ("min_cluster_count", int, None, None),
    ("smothing_factor", str, "intrinsic dimensionality", None),
    ("norm_type", str, "local", ("local", "global")),
    ("knn", int, 256, None),
    ("feature_space", str, "histogram_moments", ("histogram_moments", "gabor_filters", "quadtree")),
    ("moment_count", int, 5, None),
    ("gabor_octave_count", int, 2, None),
    ("gabor_octave_jump", float, 1.4, None),
    ("gabor_angle_sensitivity", float, 0.698132, None),
    ("gabor_lowest_central_freq", float, None, None),
    ("gabor_lowest_central_freq_ratio", float, 1.0, None),
    ("quadtree_number_of_levels", int, 3, None),
    ("steps", int, None, None),
    ("clusters", int, None, None),
    ("precondition_runs", int, 25, None),
    ("NMF_max_itter", int, 4000, None),
    ("cutt_off", float, 1e-16, None),
    ("r_guess_precondition_runs", int, 5, None),
    ("total_NMF_boost_runs", int, 6, None),
    ("boosting_calulation_runs", int, 5, None),
)
SWITCHES = ("output_features", "do_compression", "auto-scale", "show_SLIC_gui", "show_labels_gui", "enable_NMF_debug_vector")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("input_image")
    p.add_argument("output_file")
    p.add_argument("--base_scale", nargs="*", default=["2%"], help="pixels, or a share of the larger side; the largest counts")
    for name, kind, default, choices in FLAGS:
        p.add_argument(f"--{name}", type=kind, default=default, choices=choices)
    for name in SWITCHES:
        p.add_argument(f"--{name}", action="store_true")
    levels = p.add_mutually_exclusive_group()
    levels.add_argument("--number_of_levels", type=int)
    levels.add_argument("--scale_decay_rate", type=float)
    return p


def lab_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(pixels (r, c, v: L, a, b), rows, cols) of one image file."""
    bands = rasters.images(spark, path).where("band < 3").groupBy("r", "c").pivot("band", [0, 1, 2]).agg(F.first("v"))
    pixels = settle(bands.select("r", "c", F.array(*colour.lab(F.col("0"), F.col("1"), F.col("2"))).alias("v")))
    rows, cols = pixels.agg(F.max("r") + 1, F.max("c") + 1).first()
    return pixels, int(rows), int(cols)


def feature_options(args: argparse.Namespace, scale: float) -> dict:
    if args.feature_space == "histogram_moments":
        return {"count": args.moment_count}
    if args.feature_space == "quadtree":
        return {"levels": args.quadtree_number_of_levels}
    return {"octaves": args.gabor_octave_count, "jump": args.gabor_octave_jump, "angle": args.gabor_angle_sensitivity, "frequency": args.gabor_lowest_central_freq or args.gabor_lowest_central_freq_ratio / scale}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.output_features and args.feature_space == "gabor_filters":
        print("features of Gabor filters depend on the scale and are not written", file=sys.stderr)
        return 4
    if args.show_SLIC_gui or args.show_labels_gui or args.enable_NMF_debug_vector:
        print("windows are not shown; the tables hold what they would show", file=sys.stderr)
    spark = spark or SparkSession.builder.getOrCreate()
    began = time.time()
    pixels, rows, cols = lab_pixels(spark, args.input_image)
    side = max(rows, cols)
    base = max(1, int(max(percent_or_absolute(x, side) for x in args.base_scale)))
    highest = percent_or_absolute(args.max_scale, side)
    slic = SlicParams(args.m_base, args.m_scale, args.sigma, args.SLIC_max_itters, args.min_cluster_size, args.min_cluster_count or 1, args.total_runs)
    parts, nodes, node_atoms = hierarchical_superpixels(pixels, rows, cols, base, highest, slic)
    took = time.time() - began
    flat = pixels.select("r", "c", F.posexplode("v").alias("band", "v"))

    def describe(region_atoms: DataFrame, scale: float = base) -> DataFrame:
        where = region_atoms.join(parts.select("r", "c", F.col("region").alias("atom")), "atom").select("r", "c", "region")
        return descriptors(flat, where, args.feature_space, **feature_options(args, scale))

    out = {"runs": rle.encode(parts.select(F.col("r").alias("line"), F.col("c").alias("pos"), F.col("region").alias("value"))), "nodes": nodes, "node_atoms": node_atoms}
    if args.output_features:
        out["nodes"] = nodes.join(describe(node_atoms.withColumnRenamed("node", "region")).withColumnRenamed("i", "node"), "node", "left")
    if args.clustering_algorithum != "none":
        known = sorted(r.scale for r in hierarchy.scales(nodes).collect())
        scales = None
        if args.number_of_levels or args.scale_decay_rate:
            low, high = max(known[0], base), min(known[-1], highest)
            scales = geometric_scales(low, high, args.number_of_levels, args.scale_decay_rate) if low < high else [high]
        try:
            smoothing: str | float = float(args.smothing_factor)
        except ValueError:
            smoothing = args.smothing_factor
        search = {"tries": args.precondition_runs, "most": args.NMF_max_itter, "stop": args.cutt_off}
        graph = GraphParams(args.knn, args.norm_type, smoothing, args.steps, search, args.r_guess_precondition_runs, args.total_NMF_boost_runs, args.boosting_calulation_runs)
        out["labels"] = label_stack(nodes, node_atoms, describe, scales, method=args.clustering_algorithum, params=graph, k=args.clusters)
    meta = {"image_shape": f"{rows} {cols} 3", "SLIC_time": took, "total_time": time.time() - began}
    sinks.write_map(args.output_file, "zstd" if args.do_compression else "none", meta, **out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
