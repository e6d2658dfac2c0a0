"""Hand-computed results and properties of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import colour, scalar
from terravane.operators import cluster, filters, graph, hierarchy, linalg, merge, neighbours, nmf, order, regions, rle, slic, stats
from terravane.plans import labelling
from terravane.sources import documents, rasters, sinks


def grid(spark, rows):
    return spark.createDataFrame([(r, c, x) for r, row in enumerate(rows) for c, x in enumerate(row)], "r long, c int, region long")


def test_runs_end_with_the_line(spark):
    lines = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 2), (1, 2, 2)], "line int, pos int, value int")
    runs = rle.encode(lines).orderBy("line", "run_no").collect()
    assert [(r.run_length, r.value) for r in runs] == [(2, 1), (1, 2), (3, 2)]
    assert sorted(map(tuple, rle.decode(rle.encode(lines)).collect())) == sorted(map(tuple, lines.collect()))


def test_roots_of_keys_far_apart(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)] + [(200, None), (201, 200)], "node long, parent long")
    keys = spark.createDataFrame([(0,), (99,), (201,)], "node long")
    assert sorted(r.node for r in hierarchy.roots_of(nodes, keys).collect()) == [0, 201]


def test_adjacency(spark):
    assert {tuple(r) for r in neighbours.adjacency(grid(spark, [[0, 0, 1], [2, 2, 1]])).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_moments(spark):
    values = spark.createDataFrame([(0, 0, float(v)) for v in (1, 2, 3, 6)], "region int, band int, v double")
    got = {r.moment: r.value for r in stats.moments(values, 3).collect()}
    assert got == pytest.approx({0: 3.0, 1: 3.5**0.5 / 2, 2: 4.5 ** (1 / 3) / 6})


def test_merge_cost_golden(spark):
    st_ = spark.createDataFrame([(1, 0, 2, 0.0, 0.0, 0.0, 0.0), (2, 0, 3, 15.0, 0.0, 0.0, 0.0)], "region int, band int, n long, s double, ss double, sr double, sc double")
    assert stats.merge_cost(spark.createDataFrame([(1, 2)], "a int, b int"), st_, 0.0, 1.0).first().error == pytest.approx(30.0)


def test_components_golden(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    assert {r.node: r.label for r in neighbours.least_labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in neighbours.least_labels(edges).collect()} == {0}


def test_weights_and_diffusion_golden(spark):
    scaled = spark.createDataFrame([(i, j, 0.0) for i in (0, 1) for j in (0, 1)], "i long, j long, f double")
    w = graph.weights(scaled, 1.0)
    assert {r.w for r in w.collect()} == {2.0}
    m = graph.diffusion(w)
    assert {r.w for r in m.collect()} == {0.5}
    heat = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.0)], "i long, comp int, v double")
    assert {r.v for r in graph.power_times(m, heat, 3).collect()} == {0.5}


def test_columns_of_a_diffusion_matrix_sum_to_one(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.random(5).tolist()) for i in range(60)], "i long, f array<double>")
    m = graph.diffusion(graph.weights(graph.normalised(graph.nearest(points, 10, block=16), "local"), 1.0))
    assert all(r.s == pytest.approx(1.0) for r in m.groupBy("j").agg(F.sum("w").alias("s")).collect())


def test_nearest_is_exact_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.random((90, 4))
    x[10] = x[20]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, f array<double>")
    got = {(r.i, r.rank): r.j for r in graph.nearest(points, 7, block=13).collect()}
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert [got[i, k + 1] for k in range(7)] == np.lexsort((np.arange(90), d))[:7].tolist()


def test_cut(spark):
    nodes = spark.createDataFrame([("root", None, 9.0), ("a", "root", 5.0), ("b", "root", 1.0), ("x", "a", 1.0), ("y", "a", 1.0)], "node string, parent string, scale double")
    for scale, want in ((6, "ab"), (5, "bxy"), (10, ("root",)), (0.5, "bxy")):
        assert {r.node for r in hierarchy.cut(nodes, scale).collect()} == set(want)


def test_fill_sweep_prefers_left(spark):
    got = {r.c: r.region for r in neighbours.fill_sweep(grid(spark, [[7, 9, 9, 4]]), spark.createDataFrame([(9,)], "region long")).collect()}
    assert [got[c] for c in range(4)] == [7, 7, 4, 4]


def test_fill_holes_ends(spark):
    assert {r.region for r in neighbours.fill_holes(grid(spark, [[9, 9, 9, 9, 1]]), spark.createDataFrame([(9,)], "region long")).collect()} == {1}
    alone = grid(spark, [[9, 9]])
    assert {r.region for r in neighbours.fill_holes(alone, spark.createDataFrame([(9,)], "region long")).collect()} == {9}


def test_stack_to_tree(spark):
    coarse, fine = {0: 0, 1: 0, 2: 0, 3: 1}, {0: 0, 1: 1, 2: 1, 3: 1}
    rows = [(2.0, a, k) for a, k in coarse.items()] + [(1.0, a, k) for a, k in fine.items()]
    got = {(r.node, r.parent, r.n) for r in hierarchy.from_stack(spark.createDataFrame(rows, "scale double, atom int, label int"), [2.0, 1.0]).collect()}
    assert got == {("0", None, 3), ("1", None, 1), ("0/0", "0", 1), ("0/1", "0", 2), ("1/1", "1", 1)}


def test_relabel_joins_diagonals(spark):
    got = {(r.r, r.c): r.label for r in neighbours.relabel(grid(spark, [[1, 0, 1], [0, 1, 0]]), 3).collect()}
    assert got[0, 0] == got[1, 1] == got[0, 2] and got[0, 1] == got[1, 0] == got[1, 2] != got[0, 0]


def test_merge_round_keeps_parallel_edges(spark):
    costs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 5.0), (2, 3, 6.0)], "a long, b long, error double")
    labels, left, cut = merge.merge_round(costs, costs, 1)
    assert cut == 1.0 and [tuple(r) for r in left.collect()] == [(1, 3), (1, 3)]
    assert {r.node: r.label for r in labels.collect()} == {1: 1, 2: 1}


def test_constant_image_is_unchanged_by_filters(spark):
    px = spark.createDataFrame([(r, c, 0, 2.5) for r in range(5) for c in range(6)], "r long, c int, band int, v double")
    kernel = filters.gaussian(1.0)
    assert {round(r.v, 9) for r in filters.separable(px, kernel, kernel, 5, 6).collect()} == {2.5}
    edge = {(r.r, r.c): r.v for r in filters.convolve(px, [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)], 5, 6, "zero").collect()}
    assert edge[2, 2] == pytest.approx(2.5) and edge[0, 0] == pytest.approx(2.5 * 4 / 9)


def test_lab_roundtrip(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame(rng.random((50, 3)).tolist() + [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]], "x double, y double, z double")
    lab = rows.select("*", *[c.alias(n) for c, n in zip(colour.lab(F.col("x"), F.col("y"), F.col("z")), "lab", strict=True)])
    back = lab.select("x", "y", "z", "l", *[c.alias(n) for c, n in zip(colour.rgb(F.col("l"), F.col("a"), F.col("b")), "rgb", strict=True)])
    for r in back.collect():
        assert (r.r, r.g, r.b) == pytest.approx((r.x, r.y, r.z), abs=2e-3)
    assert back.orderBy(F.desc("l")).first().l == pytest.approx(100.0, abs=1e-2)


def test_scales_and_arguments():
    assert scalar.percent_or_absolute("5%", 200) == 10 and scalar.percent_or_absolute("7.5", 200) == 7.5
    with pytest.raises(ValueError):
        scalar.percent_or_absolute("five", 1)
    found = scalar.geometric_scales(2.0, 32.0, levels=4)
    assert found == pytest.approx([32, 16, 8, 4])
    assert scalar.geometric_scales(1.0, 8.0, decay=0.5) == pytest.approx([8, 4, 2, 1])


@settings(max_examples=30, deadline=None)
@given(st.sampled_from([2, 3, 4]), st.integers(0, 10_000))
def test_small_matrices(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((n, n)) + n * np.eye(n), rng.random((n, n))
    assert np.allclose(scalar.small_matrix("mul", a, b), a @ b) and np.allclose(scalar.small_matrix("mul_t", a, b), a @ b.T)
    assert np.allclose(scalar.small_matrix("inv", a) @ a, np.eye(n)) and np.isclose(scalar.small_matrix("det", a), np.linalg.det(a))


def test_small_matrix_limits():
    with pytest.raises(ValueError):
        scalar.small_matrix("inv", np.eye(8))
    with pytest.raises(ValueError):
        scalar.small_matrix("dot", np.eye(16), np.ones(16))


def stochastic(n=40, r=4, seed=0):
    rng = np.random.default_rng(seed)
    f, g = rng.random((n, r)) ** 8, rng.random((r, n)) ** 8
    return nmf.columns_to_one(nmf.columns_to_one(f) @ nmf.columns_to_one(g))


def test_factors_are_stochastic_and_improve():
    m = stochastic()
    for f, g, e in (nmf.factorise(m, 2, 2, 50), nmf.projected(m, 1, 2), nmf.boosted(m, lambda x, steps, seed: nmf.factorise(x, steps, 2, 30, seed), 2, 2)):
        assert (f >= 0).all() and (g >= 0).all() and np.allclose(f.sum(0), 1) and np.allclose(g.sum(0), 1)
        start = nmf.columns_to_one(np.ones((len(m), f.shape[1])) + np.arange(f.shape[1]))
        assert e <= nmf.error(m, start, nmf.solve_g(m, start, 2), 2) + 1e-9


def test_nnls_matches_active_set_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, y = rng.random((12, 5)), rng.standard_normal(12)
        x = nmf.nnls(a.T @ a, a.T @ y)
        w = a.T @ (y - a @ x)
        assert (x >= 0).all() and (w <= 1e-8).all() and np.allclose(w[x > 1e-9], 0, atol=1e-7)


def test_error_term_on_tables_is_the_same(spark):
    m = stochastic(12, 3)
    rng = np.random.default_rng(2)
    f, g = nmf.columns_to_one(rng.random((12, 3))), nmf.columns_to_one(rng.random((3, 12)))
    table = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(*x.shape)], "i long, j long, v double")
    got = linalg.error_term(table(m @ g.T), table(f), table(g)).first().error
    assert got == pytest.approx(nmf.error(m, f, g, 1))
    assert got == pytest.approx(((m - f @ g) ** 2).sum() - (m**2).sum())


def test_gradient_step_on_tables_matches_numpy(spark):
    m, rng = stochastic(10, 3), np.random.default_rng(6)
    gamma, delta = rng.random((10, 3)) + 0.1, rng.random((3, 10)) + 0.1
    table = lambda x, v="v": spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(*x.shape)], f"i long, j long, {v} double")
    new, _ = nmf.gradient_step(table(m, "w"), table(gamma), table(delta), 2, 0.5)
    f, g = nmf.columns_to_one(gamma), nmf.columns_to_one(delta)
    grad = m @ m @ g.T - f @ (g @ g.T)
    n = gamma.sum(0)
    want = np.maximum(0, gamma + 0.5 * (grad / n - (grad * gamma).sum(0) / n**2))
    for r in new.collect():
        assert r.v == pytest.approx(want[r.i, r.j])


def test_next_scale_bisection():
    spread = lambda known: lambda k: known[k]
    assert labelling.next_scale(spread([1, 1, 1, 2, 2, 2]), 6, 0) == 3
    assert labelling.next_scale(spread([1] * 6), 6, 0) == 5
    assert labelling.next_scale(spread([1, 2]), 2, 0) is None
    assert labelling.next_scale(spread([1, 2, 2]), 3, 0) is None


def test_running_sum_and_index(spark):
    rows = [(int(x), 1) for x in np.random.default_rng(7).permutation(500)]
    got = order.dense_index(spark.createDataFrame(rows, "k long, one int").repartition(7), ["k"]).collect()
    assert all(r["k"] == r["index"] for r in got)
    assert order.cut_off(spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "v double"), "v", 2) == 2.0


def test_sinks_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([(0, 0, 2, 1)], "line int, run_no int, run_length int, value int")
    labels = spark.createDataFrame([(2.0, 1, 5), (3.0, 1, 6)], "scale double, atom int, label int")
    sinks.write_map(str(tmp_path / "m"), "zstd", {"image_shape": "2 3 3"}, runs=runs, labels=labels)
    assert sinks.read_map(spark, str(tmp_path / "m"), "runs").collect() == runs.collect()
    assert sinks.read_map(spark, str(tmp_path / "m"), "labels").where("scale = 3").first().label == 6
    assert sinks.read_map(spark, str(tmp_path / "m"), "meta").first().value == "2 3 3"
    with pytest.raises(ValueError):
        sinks.read_map(spark, str(tmp_path / "m"), "other")
    with pytest.raises(ValueError):
        sinks.write_map(str(tmp_path / "n"), other=runs)


def test_picture_and_image_scan(spark, tmp_path):
    sinks.write_picture(grid(spark, [[0, 1], [1, 0]]), str(tmp_path / "p"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert lines[:3] == ["P3", "2 2", "255"] and len(lines) == 5
    # A bitmap of 2 x 1 pixels, red and white, by hand.
    head = b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.bmp").write_bytes(head + bytes([0, 0, 255, 255, 255, 255, 0, 0]))
    got = {(r.r, r.c, r.band): r.v for r in rasters.images(spark, str(tmp_path / "i")).collect()}
    assert got == {(0, 0, 0): 1.0, (0, 0, 1): 0.0, (0, 0, 2): 0.0, (0, 1, 0): 1.0, (0, 1, 1): 1.0, (0, 1, 2): 1.0}


def test_feature_lines(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "region int, f array<double>")
    assert {r.region: r.line for r in sinks.feature_lines(rows).collect()} == {0: "1.0, 2.0", 1: "<Not in file>"}


def test_extra_data(spark):
    rows = spark.createDataFrame([(0, {"F": [1.0]}), (1, {})], "region int, extra map<string, array<double>>")
    assert [tuple(r) for r in regions.extra(rows, "F").collect()] == [(0, [1.0])]


def test_gabor_energy_finds_its_direction(spark):
    rows = [(r, c, 0, math.cos(2 * math.pi * 0.25 * c)) for r in range(24) for c in range(24)]
    px = spark.createDataFrame(rows, "r long, c int, band int, v double")
    one = px.select("r", "c", F.lit(1).cast("long").alias("region"))
    got = {(r.direction, r.part): r.energy for r in stats.gabor(px, one, octaves=1, frequency=0.25, angle=math.pi / 2).collect()}
    assert all(got[0, k] > 10 * got[1, k] >= 0 for k in (0, 1))


def test_slic_without_a_centre_in_reach(spark):
    px = spark.createDataFrame([(0, 0, [0.0]), (90, 90, [0.0])], "r long, c int, v array<double>")
    centre = spark.createDataFrame([(1, 0.0, 0.0, [0.0])], "k long, r double, c double, v array<double>")
    got = {r.r: r.k for r in slic.assign(px, centre, 8, 20).collect()}
    assert got == {0: 1, 90: None}
    assert slic.update(slic.assign(px.limit(0), centre, 8, 20), centre).first().r == 0.0


def test_kmeans_and_spectral_part_clear_groups(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (20, 2)), rng.normal(3, 0.05, (20, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, f array<double>")
    for got in (cluster.kmeans(points, 2), labelling.label(points, "spectral", labelling.GraphParams(knn=8, steps=2, norm="global", smoothing=0.01), k=2)):
        label = {r.i: r.label for r in got.collect()}
        assert len({label[i] for i in range(20)}) == 1 and len({label[i] for i in range(20, 40)}) == 1 and label[0] != label[20]


def test_estimate_steps_and_dimension(spark):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, rng.random(2).tolist() + [0.0]) for i in range(80)], "i long, f array<double>")
    scaled = graph.normalised(graph.nearest(points, 20), "local")
    factor, dimension = graph.intrinsic(scaled)
    assert factor > 0 and 0.5 < dimension < 4
    assert graph.estimate_steps(graph.weights(scaled, factor)) >= 1
    assert graph.suggested_steps(100, 2.0) == 20


def bitmap(path, image):
    """Write an array (rows, cols, 3) of red, green, blue as a bitmap file."""
    rows, cols, _ = image.shape
    pad = bytes(-3 * cols % 4)
    body = b"".join(image[r, :, ::-1].astype(np.uint8).tobytes() + pad for r in range(rows - 1, -1, -1))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    head += cols.to_bytes(4, "little") + rows.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    path.write_bytes(head + body)


def test_command_line(spark, tmp_path):
    from terravane.plans import cli

    image = np.zeros((32, 32, 3), int)
    image[:, 16:] = 230
    image += np.random.default_rng(3).integers(0, 8, image.shape)
    bitmap(tmp_path / "i.bmp", image)
    out = str(tmp_path / "out")
    flags = ["--base_scale", "8", "--max_scale", "20", "--SLIC_max_itters", "3", "--min_cluster_size", "8", "--clusters", "2", "--number_of_levels", "2", "--knn", "4", "--do_compression", "--output_features", "--total_runs", "2"]
    assert cli.main([str(tmp_path / "i.bmp"), out, *flags], spark) == 0
    runs = sinks.read_map(spark, out, "runs")
    atoms = rle.decode(runs)
    assert atoms.count() == 32 * 32
    labels = {(r.scale, r.atom): r.label for r in sinks.read_map(spark, out, "labels").collect()}
    finest = min(s for s, _ in labels)
    sides = {}
    for r in atoms.collect():
        sides.setdefault(int(r.pos >= 16), []).append(labels[finest, r.value])
    left, right = (max(set(x), key=x.count) for x in (sides[0], sides[1]))
    assert left != right and sides[0].count(left) > 450 and sides[1].count(right) > 450
    assert sinks.read_map(spark, out, "nodes").where("f is null").count() == 0
    assert {r.name for r in sinks.read_map(spark, out, "meta").collect()} == {"image_shape", "SLIC_time", "total_time"}
    assert cli.main(["a", "b", "--output_features", "--feature_space", "gabor_filters"], spark) == 4


@pytest.mark.parametrize("space,size", [("histogram_moments", 10), ("quadtree", 42), ("gabor_filters", 32)])
def test_descriptors_have_one_length(spark, space, size):
    rng = np.random.default_rng(4)
    px = spark.createDataFrame([(r, c, b, float(rng.random())) for r in range(9) for c in range(9) for b in (0, 1)], "r long, c int, band int, v double")
    where = px.select("r", "c", F.when(F.col("r") * F.col("c") == 0, F.lit("edge")).otherwise(F.lit("inside")).alias("region")).distinct()
    got = labelling.descriptors(px, where, space).collect()
    assert len(got) == 2 and {len(r.f) for r in got} == {size}


def test_nested_documents(spark):
    tree = [{"scale": 9.0, "list_of_atomic_superpixels": [0, 1, 2], "area": 3, "children": [{"scale": 1.0, "list_of_atomic_superpixels": 0}, {"scale": 1.0, "list_of_atomic_superpixels": [1, 2], "mean": [0.5, 1]}]}]
    nodes, atoms, extra = documents.tree_tables(spark, tree)
    assert {(r.node, r.parent, r.scale) for r in nodes.collect()} == {("0", None, 9.0), ("0/0", "0", 1.0), ("0/1", "0", 1.0)}
    assert {(r.node, r.name, tuple(r.value)) for r in extra.collect()} == {("0", "area", (3.0,)), ("0/1", "mean", (0.5, 1.0))}
    back = documents.nested_tree(nodes, atoms)
    assert back[0]["children"][1]["list_of_atomic_superpixels"] == [1, 2] and len(back) == 1
    px = grid(spark, [[0, 1, 2]])
    assert {r.c: r.region for r in hierarchy.indicator(nodes, atoms, px, 5.0).collect()} == {0: "0/0", 1: "0/1", 2: "0/1"}
    assert {tuple(r) for r in documents.stack_table(spark, [{"scale": 2, "label_map": [{"list_of_atomic_superpixels": [0, 1]}, {"list_of_atomic_superpixels": 2}]}]).collect()} == {(2.0, 0, 0), (2.0, 0, 1), (2.0, 1, 2)}
    for wrong, error in (({"scale": 1.0}, KeyError), ({"scale": "1", "list_of_atomic_superpixels": [1]}, TypeError), ({"list_of_atomic_superpixels": ["a"]}, TypeError)):
        with pytest.raises(error):
            documents.tree_tables(spark, [wrong])


def test_matrix_forms(spark):
    dense = [[0.0, 2.0], [3.0, 0.0]]
    want = {(0, 1, 2.0), (1, 0, 3.0)}
    rows = linalg.from_rows(spark.createDataFrame(list(enumerate(dense)), "i long, f array<double>"))
    assert {tuple(r) for r in rows.collect()} == want
    assert {tuple(r) for r in linalg.from_compressed(spark, [2.0, 3.0], [1, 0], [0, 1, 2]).collect()} == want
    assert {tuple(r) for r in linalg.from_triples(spark, [1.0, 1.0, 3.0], [0, 0, 1], [1, 1, 0]).collect()} == want


def test_own_feature_space_and_other_rasters(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 5.0)], "r long, c int, band int, v double")
    where = grid(spark, [[4, 4]])
    most = lambda pixels, pixel_region: regions.for_raster(pixel_region, pixels).groupBy("region").agg(F.max("v").alias("value")).select("region", F.lit(0).alias("at"), "value")
    assert [(r.i, r.f) for r in labelling.descriptors(px, where, most).collect()] == [(4, [5.0])]
    assert [r.v for r in regions.value_at(px, 0, 1).collect()] == [5.0]
