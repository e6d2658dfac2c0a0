"""Nested documents of region trees and stacks, as other tools exchange them, to and from flat tables."""

from __future__ import annotations

import json
import subprocess
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settle

KNOWN = {"scale", "list_of_atomic_superpixels", "children"}


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{what} must be a number, not {type(value).__name__}")
    return float(value)


def _atoms(node: dict) -> list[int]:
    if "list_of_atomic_superpixels" not in node:
        raise KeyError("a region needs list_of_atomic_superpixels")
    found = node["list_of_atomic_superpixels"]
    found = [found] if isinstance(found, int) else list(found)  # a single atom may stand alone
    if not all(isinstance(a, int) and not isinstance(a, bool) for a in found):
        raise TypeError("atoms must be integers")
    return found


def _walk(roots: list[dict], top: str = ""):
    """(node, parent, scale, atoms, extra) of nested regions; a node's name is its way from the root."""
    todo = [(f"{top}{i}", None, x) for i, x in enumerate(roots)]
    while todo:
        name, parent, node = todo.pop()
        extra = []
        for k in sorted(set(node) - KNOWN):
            values = node[k] if isinstance(node[k], (list, tuple)) else [node[k]]
            extra.append((k, [_number(v, k) for v in values]))
        yield name, parent, _number(node.get("scale", 0.0), "scale"), _atoms(node), extra
        todo += [(f"{name}/{i}", name, x) for i, x in enumerate(node.get("children") or [])]


NODE = "node string, parent string, scale double, atoms array<long>, extra array<struct<name: string, value: array<double>>>"


def _tables(walked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    extra = walked.select("node", F.explode("extra").alias("e")).select("node", "e.name", "e.value")
    return walked.select("node", "parent", "scale"), walked.select("node", F.explode("atoms").alias("atom")), extra


def tree_tables(spark: SparkSession, roots: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, node_atoms, extra) of nested regions {scale, list_of_atomic_superpixels, children, further numeric fields}.

    A node's name is its way from the root; extra is (node, name, value array). Missing and wrong fields raise.
    """
    return _tables(spark.createDataFrame(list(_walk(roots)), NODE))


FORESTS, MAPS, ATOMS = ("HSLIC", "texture_tree"), ("texture_lists",), ("atomic_SLIC_rle",)


def load_region_map(spark: SparkSession, path: str, name: str):
    """One entity of JSON documents (a file each), parsed where the files are read.

    HSLIC and texture_tree give (nodes, node_atoms, extra), texture_lists gives (file, scale, region, atom), atomic_SLIC_rle
    (file, run_no, run_length, value). In names of nodes the file comes first. Files without the entity and wrong fields raise.
    """
    if name not in (*FORESTS, *MAPS, *ATOMS):
        raise ValueError(f"unknown entity: {name}")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kinds = {k: NODE for k in FORESTS} | {k: "file string, scale double, region long, atom long" for k in MAPS} | {k: "file string, run_no long, run_length long, value long" for k in ATOMS}

    def rows(file: str, found) -> list[tuple]:
        if name in FORESTS:
            return list(_walk(found, f"{file}:"))
        if name in MAPS:
            return [(file, *r) for r in _stack(found)]
        if not all(isinstance(r, list) and len(r) == 2 and all(isinstance(x, int) for x in r) for r in found):
            raise TypeError("runs must be pairs of integers")
        return [(file, n, *r) for n, r in enumerate(found)]

    def parse(batches):
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                document = json.loads(text)
                if name not in document:
                    raise KeyError(f"{file} has no {name}")
                yield pd.DataFrame(rows(file, document[name]), columns=[c.split()[0] for c in kinds[name].replace("struct<name: string, value: array<double>>", "x").split(", ")])

    found = files.mapInPandas(parse, kinds[name])
    return _tables(settle(found)) if name in FORESTS else found


def _stack(stack: list[dict]):
    for level in stack:
        for i, region in enumerate(level["label_map"]):
            for a in _atoms(region):
                yield _number(level["scale"], "scale"), i, a


def stack_table(spark: SparkSession, stack: list[dict]) -> DataFrame:
    """(scale, region, atom) of a list of {scale, label_map: [regions]}: one map a scale."""
    return spark.createDataFrame(list(_stack(stack)), "scale double, region long, atom long")


def nested_tree(nodes: DataFrame, node_atoms: DataFrame) -> list[dict]:
    """The nested form of a forest that fits the driver, for export."""
    tree = {r.node: {"scale": r.scale, "list_of_atomic_superpixels": [], "children": []} for r in nodes.toLocalIterator()}
    for r in node_atoms.orderBy("node", "atom").toLocalIterator():
        tree[r.node]["list_of_atomic_superpixels"].append(r.atom)
    roots = []
    for r in nodes.orderBy("node").toLocalIterator():
        (tree[r.parent]["children"] if r.parent is not None else roots).append(tree[r.node])
    return roots


def external_labels(spark: SparkSession, paths: list[str], command: list[str], rows: int, cols: int) -> DataFrame:
    """(file, r, c, region): what an outside program makes of image files, one run of it a file, on the executors.

    The program is given the file and the path of the result that it must write: 32-bit little-endian numbers in raster order.
    The files must be readable where the tasks run. A program that fails or writes another size fails its task.
    """

    def run(batches):
        for pdf in batches:
            for file in pdf["file"]:
                with tempfile.TemporaryDirectory() as folder:  # for the life of the program alone
                    out = f"{folder}/labels.dat"
                    subprocess.run([*command, file, out], check=True)
                    found = np.fromfile(out, "<i4")
                if len(found) != rows * cols:
                    raise ValueError(f"{len(found)} labels for {rows} x {cols} pixels")
                at = np.arange(len(found))
                yield pd.DataFrame({"file": file, "r": at // cols, "c": at % cols, "region": found.astype(np.int64)})

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "file string, r long, c long, region long")
