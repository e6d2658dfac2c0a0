"""Engine operators that the planted queries do not reach: large inputs by other ways, wrong input, and steps one by one."""

import json
import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import scalar
from terravane.operators import cluster, graph, neighbours, nmf, order, regions, rle, slic, stats
from terravane.plans import labelling, queries
from terravane.sources import documents, tables


def grid(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "r long, c int, region long")


def sweeps(label, gone):
    """All sweeps in plain numpy: up, down, left, right, the first kept neighbour counts."""
    label, gone = label.copy(), gone.copy()
    while True:
        new, left = label.copy(), gone.copy()
        for r, c in np.argwhere(gone):
            for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                y, x = r + dr, c + dc
                if 0 <= y < label.shape[0] and 0 <= x < label.shape[1] and not gone[y, x]:
                    new[r, c], left[r, c] = label[y, x], False
                    break
        if (left == gone).all():
            return label
        label, gone = new, left


@pytest.mark.parametrize("seed", [0, 1])
def test_holes_over_many_tiles(spark, seed):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 6, (30, 23))
    label[4:25, 3:20] = 5
    removable = [2, 5]
    want = sweeps(label, np.isin(label, removable))
    gone = spark.createDataFrame([(x,) for x in removable], "region long")
    for margin, tile in ((3, 5), (8, 8)):
        now = grid(spark, label.tolist())
        while True:
            now = tables.settle(neighbours.fill_sweeps(now, gone, margin, tile))
            if now.where("gone").isEmpty():
                break
        assert all(r.region == want[r.r, r.c] for r in now.collect())


def test_a_hole_of_a_thousand_pixels_is_filled(spark):
    line = grid(spark, [[1] + [2] * 1200 + [3]])
    got = neighbours.fill_holes(line, spark.createDataFrame([(2,)], "region long"), 200)
    assert {r.region: r["count"] for r in got.groupBy("region").count().collect()} == {1: 601, 3: 601}
    alone = neighbours.fill_holes(grid(spark, [[2, 2]]), spark.createDataFrame([(2,)], "region long"))
    assert {r.region for r in alone.collect()} == {2}


def test_cut_off_by_ranges(spark):
    values = np.round(np.random.default_rng(3).random(500), 2)
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double").repartition(5)
    for n in (1, 7, 250, 499, 500, 900):
        assert order.cut_off(df, "v", n) == sorted(values)[min(n, 500) - 1]
    assert order.cut_off(df.limit(0), "v", 3) is None


def test_leading_eigenvectors(spark):
    rng = np.random.default_rng(5)
    w = rng.random((14, 14))
    w = w + w.T
    w[:7, 7:] *= 0.02
    w[7:, :7] *= 0.02
    rows = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(14) for j in range(14)], "i long, j long, w double")
    values, vectors = graph.leading(rows, 2, rounds=40, tolerance=1e-8)
    d = 1 / np.sqrt(w.sum(0))
    want, basis = np.linalg.eigh(d[:, None] * w * d[None])
    assert values == pytest.approx(want[::-1][:2].tolist(), abs=1e-5)
    got = np.array([r.f for r in vectors.orderBy("i").collect()])
    assert np.abs(np.abs(got.T @ basis[:, ::-1][:, :2]) - np.eye(2)).max() < 1e-2
    label = {r.i: r.label for r in cluster.spectral(rows, 2, most=5).collect()}
    assert len({label[i] for i in range(7)}) == 1 and len({label[i] for i in range(7, 14)}) == 1 and label[0] != label[13]


def test_starts_on_tables_cover_all_points(spark):
    m, _, _ = nmf.make_random(24, 3, seed=2)
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(24) for j in range(24)], "i long, j long, w double")
    for batch in (2, 32):
        f = nmf.start_tables(matrix, 2, batch=batch)
        sums = f.groupBy("j").agg(F.sum("v").alias("s")).collect()
        assert len(sums) >= 1 and all(r.s == pytest.approx(1) for r in sums)
    assert {tuple(r) for r in nmf.start_tables(matrix, 2, batch=2).select("i", "j", F.round("v", 9)).collect()} == {tuple(r) for r in nmf.start_tables(matrix, 2, batch=32).select("i", "j", F.round("v", 9)).collect()}


def test_boosted_on_tables_and_labels_of_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(nmf, "MOST", 3)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (6, 2)), rng.normal(9, 0.05, (6, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, f array<double>")
    params = labelling.GraphParams(knn=5, steps=2, norm="global", smoothing=0.01, nmf={"most": 1}, boost_runs=2, boosts=1)
    for method in ("NMF", "NMF-boosted"):
        label = {r.i: r.label for r in labelling.label(points, method, params).collect()}
        assert len(label) == 12 and not {label[i] for i in range(6)} & {label[i] for i in range(6, 12)}


def test_intervals_of_shares():
    low, high = nmf.confidence(3, 20)
    tail = lambda k, p: sum(math.comb(20, x) * p**x * (1 - p) ** (20 - x) for x in range(k, 21))
    assert tail(3, low) == pytest.approx(0.025) and 1 - tail(4, high) == pytest.approx(0.025)
    m, f, g = nmf.make_random(20, 2)
    share, low, high = nmf.better_than_random(m, nmf.error(m, f, g, 1), 2, 1, restarts=3)
    assert 0 <= low <= share <= high <= 1


def test_wrong_runs_raise(spark):
    runs = lambda *x: spark.createDataFrame([(n, *r) for n, r in enumerate(x)], "run_no long, run_length long, value long")
    assert {tuple(r) for r in rle.decode_raster(runs((3, 7), (1, 8)), 2, 2).collect()} == {(0, 0, 7), (0, 1, 7), (1, 0, 7), (1, 1, 8)}
    for wrong in (runs((3, 7)), runs((5, 7), (-1, 8)), runs((4, None))):
        with pytest.raises(Exception, match="runs must be positive"):
            rle.decode_raster(wrong, 2, 2).collect()


def test_documents_from_files(spark, tmp_path):
    tree = [{"scale": 2.0, "list_of_atomic_superpixels": [0, 1], "children": [{"scale": 1.0, "list_of_atomic_superpixels": 0, "mean": 0.5}]}]
    for n, document in enumerate(({"HSLIC": tree, "atomic_SLIC_rle": [[2, 0], [1, 1]]}, {"HSLIC": tree, "atomic_SLIC_rle": [[1, 3]]})):
        (tmp_path / f"{n}.json").write_text(json.dumps(document, indent=1))
    nodes, atoms, extra = documents.load_region_map(spark, str(tmp_path), "HSLIC")
    assert nodes.count() == 4 and atoms.count() == 6 and {tuple(r.value) for r in extra.collect()} == {(0.5,)}
    runs = documents.load_region_map(spark, str(tmp_path), "atomic_SLIC_rle")
    assert sorted((r.run_no, r.run_length, r.value) for r in runs.collect()) == [(0, 1, 3), (0, 2, 0), (1, 1, 1)]
    with pytest.raises(ValueError):
        documents.load_region_map(spark, str(tmp_path), "other")
    (tmp_path / "0.json").write_text(json.dumps({"atomic_SLIC_rle": [["x", 0]]}))
    with pytest.raises(Exception, match="pairs of integers"):
        documents.load_region_map(spark, str(tmp_path), "atomic_SLIC_rle").collect()
    with pytest.raises(Exception, match="has no HSLIC"):
        documents.load_region_map(spark, str(tmp_path), "HSLIC")[0].collect()


def test_labels_of_an_outside_program(spark, tmp_path):
    program = tmp_path / "p.py"
    program.write_text("import sys, array\nn = int(open(sys.argv[1]).read())\narray.array('i', range(n)).tofile(open(sys.argv[2], 'wb'))\n")
    for name, n in (("a", 6), ("b", 5)):
        (tmp_path / name).write_text(str(n))
    got = documents.external_labels(spark, [str(tmp_path / "a")], [sys.executable, str(program)], 2, 3).collect()
    assert {(r.r, r.c): r.region for r in got} == {(r, c): 3 * r + c for r in range(2) for c in range(3)}
    with pytest.raises(Exception, match="5 labels"):
        documents.external_labels(spark, [str(tmp_path / "b")], [sys.executable, str(program)], 2, 3).collect()


def test_filter_bank_one_by_one():
    """The transform against its sum at a few frequencies, and erosion against all neighbourhoods."""
    (_, _, f, a, b, angle, size), *_ = stats.gabor_bank(1, 1.4, 0.2, 0.7)
    got = stats.gabor_transform((9, 12), f, a, b, 0.7, size)
    for y, x in ((0, 0), (3, 5), (8, 11)):
        v, u = (np.fft.fftfreq(9)[y] - f * math.sin(0.7), np.fft.fftfreq(12)[x] - f * math.cos(0.7))
        along, across = u * math.cos(0.7) + v * math.sin(0.7), -u * math.sin(0.7) + v * math.cos(0.7)
        want = math.exp(-math.pi * (along**2 / a**2 + across**2 / b**2)) / (a * b)
        assert got[y, x] == pytest.approx(want * np.exp(-2j * math.pi * size / 2 * (u + v)))
    mask = np.random.default_rng(1).random((7, 6)) > 0.2
    for size in (1, 2, 3, 4):
        wide = np.pad(mask, size, "symmetric")
        reach = range(-((size - 1) // 2), size // 2 + 1)
        want = [[all(wide[r + size + y, c + size + x] for y in reach for x in reach) for c in range(6)] for r in range(7)]
        assert (stats.eroded(mask, size) == np.array(want)).all()


def test_runs_and_tries_of_superpixels(spark):
    rng = np.random.default_rng(6)
    px = spark.createDataFrame([(r, c, [float(20 * (r // 6) + rng.random())]) for r in range(12) for c in range(12)], "r long, c int, v array<double>")
    got = slic.slic(px, 12, 12, 6, most=4, least_size=4, runs=2, tries=2)
    assert got.count() == 144 and got.groupBy("region").count().where("count < 4").isEmpty()


def test_crops_and_inverses(spark):
    px = grid(spark, [[1, 2, 1], [2, 1, 2]])
    values = px.select("r", "c", (F.col("r") * 3 + F.col("c") + 1.0).alias("v"))
    got = {(r.tile_r, r.tile_c): r.v for r in regions.crop(values, px, 1).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (0, 2): 3.0, (1, 0): 0.0, (1, 1): 5.0, (1, 2): 0.0}
    one = spark.createDataFrame([([2.0, 0.0, 0.0, 4.0], [1.0, 2.0, 2.0, 4.0], -0.0)], "a array<double>, b array<double>, x double")
    row = one.select(scalar.inverse(F.col("a"), 2).alias("a"), scalar.inverse(F.col("b"), 2).alias("b"), scalar.inverse_or_zero(F.col("x")).alias("x"), scalar.matrix_dot(F.col("b"), F.array(F.lit(1.0), F.lit(1.0)), 2).alias("d")).first()
    assert row.a == [0.5, 0.0, 0.0, 0.25] and row.b is None and row.x == -sys.float_info.max and row.d == [3.0, 6.0]


def test_safe_inverses_of_odd_values(spark, tmp_path):
    """Nulls, NaN, both zeros, large inverses and those beyond the largest number are what the SQL makes of them."""
    duckdb = pytest.importorskip("duckdb")
    odd = [None, math.nan, 0.0, -0.0, math.inf, 1e-310, -1e-310, 1e-303, 3e-12, 2.2618977521086377e-10, 0.05, -0.05, 0.07]
    rows = [(i, 1, x, y) for i, (x, y) in enumerate(zip(odd, odd[::-1], strict=True))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    found = sorted(map(tuple, queries.queries()["safe_inverses"](spark, str(tmp_path)).collect()))
    assert repr(found) == repr(sorted(con.sql(queries.oracle_sql()["safe_inverses"]).fetchall()))
