"""Queries whose inputs are planted, so that SQL knows what a search must find, and queries of files, arrays and helpers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, scalar
from ..operators import cluster, graph, hierarchy, linalg, nmf, order, regions, rle, stats
from ..operators.stats import rounded
from ..sources import documents, rasters, sinks
from ..sources.tables import new_path, read, settle
from . import labelling
from .queries import FACTORS, GEO, LABELS, MATRIX, PB, PW, PX, R6, SQL, TILES, WEIGHTS, as_matrix, factors, geo_atoms, geo_nodes, height, knn_sql, query, wide_pixels

# ---- rasters and regions --------------------------------------------------------------------------------------------


@query(f"with {PX}, {TILES} select r, c, region, {R6.format('2 * v + c')} as v from px join reg using (r, c)")
def other_raster(spark: SparkSession, d: str) -> DataFrame:
    raster = rasters.line_raster(spark, d).withColumn("v", rounded(2 * F.col("v") + F.col("c")))
    return regions.for_raster(rasters.tile_regions(spark, d), raster).select("r", "c", "region", "v")


@query(f"with {PX}, {TILES} select r, c, region as value from reg")
def rle_raster(spark: SparkSession, d: str) -> DataFrame:
    lines = rasters.tile_regions(spark, d).select(F.col("r").alias("line"), F.col("c").alias("pos"), F.col("region").alias("value"))
    runs = order.dense_index(rle.encode(lines), ["line", "run_no"], "number").select(F.col("number").alias("run_no"), "run_length", "value")
    return rle.decode_raster(settle(runs), height(spark, d), 64)


@query(f"with {PX}, {TILES} select 'key' as way, min(r * 64 + c) as place, region, (row_number() over (order by min(r * 64 + c)) - 1)::bigint as index from reg group by region")
def keys_and_indexes(spark: SparkSession, d: str) -> DataFrame:
    keys = rasters.tile_regions(spark, d).groupBy("region").agg(F.min(F.col("r") * 64 + F.col("c")).alias("place"))
    return regions.indexed(keys, ["place"]).select(F.lit("key").alias("way"), "place", "region", "index")


@query(f"with {PX}, reg as (select r, c, case when (r + c) % 2 = 0 then (r // 8) * 8 + c // 8 else -1 end as region from px) select r as tile_r, c - 25 as tile_c, {R6.format('case when region = 3 then v else 0 end')} as v from px join reg using (r, c) where r < 8 and c >= 24 and c < 32 and c - 25 >= -1")
def region_crop(spark: SparkSession, d: str) -> DataFrame:
    holes = rasters.tile_regions(spark, d).withColumn("region", F.when(F.pmod(F.col("r") + F.col("c"), F.lit(2)) == 0, F.col("region")).otherwise(-1))
    found = regions.crop(rasters.line_raster(spark, d), holes, 3)
    return found.select(F.col("tile_r").cast("long").alias("tile_r"), (F.col("tile_c") - 1).cast("long").alias("tile_c"), rounded("v").alias("v"))


@query(f"with {PB} select r, c, band, {R6.format('v')} as v from pb where r = 7 and c = 5")
def pixel_value(spark: SparkSession, d: str) -> DataFrame:
    return regions.value_at(rasters.banded_raster(spark, d), 7, 5).select("r", "c", "band", rounded("v").alias("v"))


@query(f"with {PX}, {TILES} select region, {R6.format('min(v)')} as least, {R6.format('max(v)')} as most from px join reg using (r, c) group by region having region % 2 = 0")
def extra_arrays(spark: SparkSession, d: str) -> DataFrame:
    values = rasters.line_raster(spark, d).join(rasters.tile_regions(spark, d), ["r", "c"]).groupBy("region").agg(F.array(F.min("v"), F.max("v")).alias("x"))
    name = F.when(F.pmod("region", F.lit(2)) == 0, F.lit("range")).otherwise(F.lit("other"))
    found = regions.extra(values.select("region", F.create_map(name, "x").alias("extra")), "range")
    return found.select("region", rounded(F.element_at("value", 1)).alias("least"), rounded(F.element_at("value", 2)).alias("most"))


@query(f"with {LABELS} select region, count(*) as n, count(*) >= 3200 as active from reg group by region")
def region_histogram(spark: SparkSession, d: str) -> DataFrame:
    return regions.histogram(rasters.label_regions(spark, d), 3200)


@query("select count(*) filter (where n_regionkey = n_nationkey) as active from nation")
def living_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.living(read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("label")))


@query(f"""with {GEO}, q as (select n.node from nodes n left join nodes p on p.node = n.parent
  where (n.scale < 2.5 or n.node not in (select parent from nodes where parent is not null)) and (p.node is null or p.scale >= 2.5))
select o_orderkey as r, 0 as c, q.node as region from q join atoms using (node) join orders on o_custkey = atom""")
def indicator_at_scale(spark: SparkSession, d: str) -> DataFrame:
    pixels = read(spark, d, "orders").select(F.col("o_orderkey").alias("r"), F.lit(0).alias("c"), F.col("o_custkey").alias("region"))
    return hierarchy.indicator(geo_nodes(spark, d), geo_atoms(spark, d), pixels, 2.5)


@query(f"with {PX}, {TILES} select region, string_agg(((r * 64 + c) % 7)::double::varchar, ', ' order by r, c) as line from reg where region < 8 group by region union all select 8, '<Not in file>'")
def feature_text(spark: SparkSession, d: str) -> DataFrame:
    tiles = rasters.tile_regions(spark, d).where("region < 8")
    cells = F.array_sort(F.collect_list(F.struct("r", "c", F.pmod(F.col("r") * 64 + F.col("c"), F.lit(7)).cast("double").alias("x"))))
    f = tiles.groupBy("region").agg(F.transform(cells, lambda s: s["x"]).alias("f"))
    return sinks.feature_lines(f.union(spark.createDataFrame([(8, None)], "region long, f array<double>")))


# ---- files ----------------------------------------------------------------------------------------------------------


@query(f"""with {PX}, {TILES}, {GEO} select 'runs' as entity, count(*) as n, sum(region)::bigint as total from reg union all select 'nodes', count(*), sum(scale)::bigint from nodes
union all select 'node_atoms', count(*), sum(atom)::bigint from atoms union all select 'labels', count(*), sum(atom)::bigint from atoms where node[1] = 'r'""")
def map_files(spark: SparkSession, d: str) -> DataFrame:
    """A whole map written and read back; labels are read for one scale alone."""
    path = new_path(spark, "map")
    lines = rasters.tile_regions(spark, d).select(F.col("r").alias("line"), F.col("c").alias("pos"), F.col("region").alias("value"))
    labels = geo_atoms(spark, d).select(F.when(F.col("node").startswith("r"), 3.0).otherwise(2.0).alias("scale"), "atom", F.lit(0).alias("label"))
    sinks.write_map(path, "zstd", {"image_shape": "x"}, runs=rle.encode(lines), nodes=geo_nodes(spark, d), node_atoms=geo_atoms(spark, d), labels=labels)
    back = lambda name: sinks.read_map(spark, path, name)
    parts = [("runs", rle.decode(back("runs")), "value"), ("nodes", back("nodes"), "scale"), ("node_atoms", back("node_atoms"), "atom"), ("labels", back("labels").where("scale = 3"), "atom")]
    rows = [df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.sum(c).cast("long").alias("total")) for name, df, c in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def region_documents(spark: SparkSession, d: str) -> str:
    """A JSON document for each region: the tree of its nations and customers, a stack of two maps, and runs."""
    customers, nations = read(spark, d, "customer"), read(spark, d, "nation")
    leaf = F.struct(F.lit(1.0).alias("scale"), F.array("c_custkey").alias("list_of_atomic_superpixels"), F.array(F.length("c_name").cast("double")).alias("size"))
    nation = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("atoms"), F.sort_array(F.collect_list(leaf)).alias("children"))
    nation = nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    inner = F.struct(F.lit(2.0).alias("scale"), F.col("atoms").alias("list_of_atomic_superpixels"), "children")
    tree = nation.groupBy("n_regionkey").agg(F.sort_array(F.flatten(F.collect_list("atoms"))).alias("atoms"), F.collect_list(inner).alias("children"))
    whole = F.struct(F.lit(3.0).alias("scale"), F.col("atoms").alias("list_of_atomic_superpixels"), "children")
    maps = F.array(F.struct(F.lit(3.0).alias("scale"), F.array(F.struct(F.col("atoms").alias("list_of_atomic_superpixels"))).alias("label_map")), F.struct(F.lit(2.0).alias("scale"), F.transform("children", lambda x: F.struct(x["list_of_atomic_superpixels"])).alias("label_map")))
    runs = F.transform("children", lambda x: F.array(F.size(x["list_of_atomic_superpixels"]).cast("long"), F.element_at(x["list_of_atomic_superpixels"], 1)))
    path = new_path(spark, "documents")
    tree.select("n_regionkey", F.to_json(F.struct(F.array(whole).alias("HSLIC"), maps.alias("texture_lists"), runs.alias("atomic_SLIC_rle"))).alias("value")).write.partitionBy("n_regionkey").text(path)
    return f"{path}/*/*.txt"


@query("""with c as (select c_custkey, n_nationkey, n_regionkey, length(c_name)::double as size from customer join nation on n_nationkey = c_nationkey)
select 3.0::double as scale, count(*) as n, min(c_custkey) as least, 0 as extra from c group by n_regionkey union all select 2.0, count(*), min(c_custkey), 0 from c group by n_nationkey
union all select 1.0, 1, c_custkey, size::int from c""")
def region_files(spark: SparkSession, d: str) -> DataFrame:
    nodes, atoms, extra = documents.load_region_map(spark, region_documents(spark, d), "HSLIC")
    sums = atoms.groupBy("node").agg(F.count("*").alias("n"), F.min("atom").alias("least"))
    sizes = extra.where("name = 'size'").select("node", F.element_at("value", 1).cast("int").alias("extra"))
    return nodes.join(sums, "node").join(sizes, "node", "left").select("scale", "n", "least", F.coalesce("extra", F.lit(0)).alias("extra"))


@query("""with c as (select c_custkey, n_nationkey, n_regionkey from customer join nation on n_nationkey = c_nationkey)
select 'map' as kind, 3.0::double as scale, count(*) as n, min(c_custkey) as least from c group by n_regionkey union all select 'map', 2.0, count(*), min(c_custkey) from c group by n_nationkey
union all select 'run', 0.0, count(*), min(c_custkey) from c group by n_nationkey""")
def stack_files(spark: SparkSession, d: str) -> DataFrame:
    path = region_documents(spark, d)
    maps = documents.load_region_map(spark, path, "texture_lists").groupBy("file", "scale", "region").agg(F.count("*").alias("n"), F.min("atom").alias("least"))
    runs = documents.load_region_map(spark, path, "atomic_SLIC_rle")
    return maps.select(F.lit("map").alias("kind"), "scale", "n", "least").union(runs.select(F.lit("run"), F.lit(0.0), "run_length", "value"))


@query("""select 3.0::double as scale, count(*) as n, min(c_custkey) as least from customer join nation on n_nationkey = c_nationkey group by n_regionkey
union all select 2.0, count(*), min(c_custkey) from customer group by c_nationkey union all select 1.0, 1, c_custkey from customer""")
def nested_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A forest to its nested form and back."""
    used = geo_atoms(spark, d).select("node").distinct()
    nodes, atoms, _ = documents.tree_tables(spark, documents.nested_tree(settle(geo_nodes(spark, d).join(used, "node", "left_semi")), settle(geo_atoms(spark, d))))
    return nodes.join(atoms, "node").groupBy("node", "scale").agg(F.count("*").alias("n"), F.min("atom").alias("least")).drop("node")


# ---- scalars and small matrices -------------------------------------------------------------------------------------


@query("select * from (values ('5%', 10.0::double), ('12', 12.0), ('0.5%', 1.0), ('100%', 200.0), ('2.5', 2.5)) t(text, value)")
def percent_arguments(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x, scalar.percent_or_absolute(x, 200.0)) for x in ("5%", "12", "0.5%", "100%", "2.5")], "text string, value double")


@query("select n::int as n, k::int as k, floor(n * 64 / (k * k)::double)::bigint as regions, floor(sqrt(n * 64 / k::double))::bigint as size from (select max(vec_id) + 1 as n from embeddings), range(2, 9) t(k)")
def scale_sizes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import slic

    n = int(height(spark, d))
    return spark.createDataFrame([(n, k, scalar.number_of_regions(n, 64, k), slic.size_of(n, 64, k)) for k in range(2, 9)], "n int, k int, regions long, size long")


@query("select n::int as n, d::double as d, floor(d * n ** (1 / d::double) + 1e-9)::int as steps from (values (100, 2.0), (500, 3.5), (2000, 5.0), (7, 1.0)) t(n, d) union all select 9, 0.0, 1")
def step_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, x, graph.suggested_steps(n, x)) for n, x in ((100, 2.0), (500, 3.5), (2000, 5.0), (7, 1.0), (9, 0.0))], "n int, d double, steps int")


@query("""select l_orderkey, l_linenumber, case when l_tax = 0 then 1.7976931348623157e308::double else round(1 / l_tax, 6) end as tax, case when l_discount = 0.05 then 0 when l_discount = 0 then 1.7976931348623157e308::double else round(1 / l_discount, 6) end as discount from lineitem""")
def safe_inverses(spark: SparkSession, d: str) -> DataFrame:
    """Inverses of taxes, and of discounts of which one is planted as no number; the table's own nulls, NaN and overflows stay what SQL makes of them."""
    # As SQL rounds: by a product, which for large inverses is not the nearest decimal.
    small = lambda c: F.when(F.abs(c) < 1e302, F.round(c * 1e6) / 1e6).otherwise(c)

    def safe(x, planted):
        plain = F.try_divide(F.lit(1.0), x)
        own = x.isNull() | F.isnan(x) | (F.abs(plain) == float("inf"))
        # SQL has one zero, the helper one of each sign.
        inverse = scalar.inverse_or_zero(F.when(planted, float("nan")).when(x == 0, 0.0).otherwise(x))
        return F.when(own, plain).otherwise(small(inverse))

    tax, discount = F.col("l_tax"), F.col("l_discount")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", safe(tax, F.lit(False)).alias("tax"), safe(discount, discount == 0.05).alias("discount"))


def _det(n: int, rows: tuple, cols: tuple) -> str:
    if len(rows) == 1:
        return f"m[{rows[0] * n + cols[0] + 1}]"
    return "(" + " ".join(f"{'-' if k % 2 else '+'} m[{rows[0] * n + c + 1}] * {_det(n, rows[1:], cols[:k] + cols[k + 1:])}" for k, c in enumerate(cols)) + ")"


def _dets() -> str:
    parts = [f"select vec_id as i, {n} as n, {_det(n, tuple(range(n)), tuple(range(n)))} as det, {' + '.join(f'm[{k + 1}] * m[{k + 1}]' for k in range(n * n))} as square from m" for n in (2, 3, 4)]
    return " union all ".join(parts)


@query(f"with m as (select vec_id, [floor(8 * x::double) / 4 for x in embedding[1:16]] as m from embeddings), x as ({_dets()}) select i, n, {R6.format('det')} as det, case when det <> 0 then n::double end as trace, {R6.format('square')} as square from x")
def small_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Determinants, the trace of a matrix times its inverse, and that of a matrix times its own transpose."""
    m = read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.transform(F.slice("embedding", 1, 16), lambda x: F.floor(8 * x.cast("double")) / 4.0).alias("m"))
    trace = lambda x, n: rounded(sum((F.element_at(x, k * n + k + 1) for k in range(1, n)), F.element_at(x, 1)))
    parts = []
    for n in (2, 3, 4):
        a = F.slice("m", 1, n * n)
        given = settle(m.select("i", a.alias("a"), scalar.inverse(a, n).alias("b")))
        a, b = F.col("a"), F.col("b")
        parts.append(given.select("i", F.lit(n).alias("n"), rounded(scalar.determinant(a, n)).alias("det"), trace(scalar.matrix_times(a, b, n), n).alias("trace"), trace(scalar.matrix_times_transposed(a, a, n), n).alias("square")))
    return parts[0].union(parts[1]).union(parts[2])


@query(f"with {PW} select r, c, round(greatest(0, least(1, (v[1] + 1) / 2)), 3) + 0.0::double as red, round(greatest(0, least(1, (v[2] + 1) / 2)), 3) + 0.0::double as green, round(greatest(0, least(1, (v[3] + 1) / 2)), 3) + 0.0::double as blue from pw")
def lab_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Colours there and back again."""
    x = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.element_at("v", k) + 1.0) / 2.0)) for k in (1, 2, 3)]
    labs = settle(wide_pixels(spark, d).select("r", "c", *[c.alias(n) for c, n in zip(colour.lab(*x), "lab", strict=True)]))
    return labs.select("r", "c", *[rounded(c, 3).alias(n) for c, n in zip(colour.rgb(*[F.col(n) for n in "lab"]), ("red", "green", "blue"), strict=True)])


@query("""select 'triples' as form, n_regionkey::bigint as i, (n_nationkey % 3)::bigint as j, sum(n_nationkey)::double as v from nation group by all union all
select 'compressed', r_regionkey::bigint, k, (r_regionkey * 10 + k)::double from region, range(0, 2) t(k) where r_regionkey * 10 + k >= 0 union all
select 'rows', vec_id, c - 1, embedding[c]::double from embeddings, range(1, 4) t(c) where embedding[c] <> 0""")
def matrix_forms(spark: SparkSession, d: str) -> DataFrame:
    nations = sorted((r.n_nationkey, r.n_regionkey) for r in read(spark, d, "nation").collect())
    many = read(spark, d, "region").count()
    parts = {
        "triples": linalg.from_triples(spark, [float(n) for n, _ in nations], [r for _, r in nations], [n % 3 for n, _ in nations]),
        "compressed": linalg.from_compressed(spark, [float(r * 10 + k) for r in range(many) for k in (0, 1)], [k for _ in range(many) for k in (0, 1)], [2 * r for r in range(many + 1)]),
        "rows": linalg.from_rows(rasters.features(spark, d).select("i", F.slice("f", 1, 3).alias("f"))),
    }
    rows = [m.select(F.lit(k).alias("form"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v") for k, m in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"with {FACTORS.split(',' + chr(10) + 'f as')[0]}, x as (select ga.i, ga.j, ga.v as old, 2 * ga.v + 1 as new, de.v as gradient from ga join de on de.i = ga.j and de.j = ga.i) select round(sum((new - old) * gradient), 6) + 0.0::double as total from x")
def gradient_change(spark: SparkSession, d: str) -> DataFrame:
    gamma, delta = factors(spark, d)
    return linalg.change(gamma.withColumn("v", 2 * F.col("v") + 1), gamma, linalg.transpose(delta)).select(rounded("total").alias("total"))


@query("select k::int as wins, 20 as of, round(case when k = 0 then 0 else 0.025::double ** (1 / 20.0::double) end, 6) as low, round(case when k = 0 then 1 - 0.025::double ** (1 / 20.0::double) else 1 end, 6) as high from (values (0), (20)) t(k)")
def share_interval(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, 20, *[round(x, 6) for x in nmf.confidence(k, 20)]) for k in (0, 20)], "wins int, of int, low double, high double")


@query("select 60 as n, 4 as r, 60.0::double as total, 4.0::double as f, 60.0::double as g, true as made")
def random_factors(spark: SparkSession, d: str) -> DataFrame:
    m, f, g = nmf.make_random(60, 4)
    return spark.createDataFrame([(60, 4, round(float(m.sum()), 6), round(float(f.sum()), 6), round(float(g.sum()), 6), bool(abs(m - f @ g).max() < 1e-12 and m.min() >= 0))], "n int, r int, total double, f double, g double, made boolean")


# ---- descriptors ----------------------------------------------------------------------------------------------------


@query(f"""with {PB}, {TILES.replace('from px', 'from (select distinct r, c from pb)')}, x as (select region, band, v from pb join reg using (r, c)), mu as (select region, band, avg(v) as m from x group by all),
p as (select region, band, any_value(m) as m0, avg((v - m) ** 2) as m1 from x join mu using (region, band) group by all)
select region as i, band::int as at, {R6.format('m0')} as v from p union all select region, 4 + band::int, {R6.format('sign(m1) * abs(m1) ** (1.0::double / 2) / 2')} from p
union all select region, 8, {R6.format('max(v) - min(v)')} from x group by region""")
def descriptor_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Moments in their order, and a feature space of one's own."""
    pixels, tiles = rasters.banded_raster(spark, d), rasters.tile_regions(spark, d).where("c < 16")
    spread = lambda p, where: regions.for_raster(where, p).groupBy("region").agg((F.max("v") - F.min("v")).alias("value")).select("region", F.lit(0).alias("at"), "value")
    moments = labelling.descriptors(pixels, tiles, "histogram_moments", count=2).select("i", F.posexplode("f").alias("at", "v"))
    own = labelling.descriptors(pixels, tiles, spread).select("i", F.lit(8).alias("at"), F.element_at("f", 1).alias("v"))
    return moments.union(own).withColumn("v", rounded("v"))


BANK = stats.gabor_bank(2, 1.4, 0.25, math.pi / 2)
_BANK = ", ".join(f"({o}, {k}, {f!r}::double, {a!r}::double, {b!r}::double, {math.cos(t)!r}::double, {math.sin(t)!r}::double, {s})" for o, k, f, a, b, t, s in BANK)


@query(f"""with {PB}, cells as (select r, c, band, v, (r // 8) * 8 + c // 8 as region, r % 8 as y, c % 8 as x from pb), tall as (select region, max(y) + 1 as h, max(x) + 1 as w from cells group by region),
bank(octave, direction, f, a, b, cs, sn, size) as (values {_BANK}), shapes as (select distinct h, w from tall),
fy as (select octave, direction, h, w, k as ky, (case when 2 * k < h + size - 1 then k else k - (h + size - 1) end) / (h + size - 1)::double - f * sn as qy from shapes, bank, range(0, 64) t(k) where k < h + size - 1),
fx as (select octave, direction, h, w, k as kx, (case when 2 * k < w + size - 1 then k else k - (w + size - 1) end) / (w + size - 1)::double - f * cs as qx from shapes, bank, range(0, 64) t(k) where k < w + size - 1),
tr as (select octave, direction, h, w, ky, kx, exp(-pi() * (((qx * cs + qy * sn) / a) ** 2 + ((qy * cs - qx * sn) / b) ** 2)) / (a * b) as mag, -pi() * size * (qx + qy) as ph from fy join fx using (octave, direction, h, w) join bank using (octave, direction)),
kr as (select octave, direction, h, w, dy, dx, sum(mag * cos(ph + 2 * pi() * (ky * dy / (h + size - 1)::double + kx * dx / (w + size - 1)::double))) / ((h + size - 1) * (w + size - 1)) as re,
  sum(mag * sin(ph + 2 * pi() * (ky * dy / (h + size - 1)::double + kx * dx / (w + size - 1)::double))) / ((h + size - 1) * (w + size - 1)) as im
  from tr join bank using (octave, direction), range(0, 64) s(dy), range(0, 64) t(dx) where dy < h + size - 1 and dx < w + size - 1 group by octave, direction, h, w, size, dy, dx),
cv as (select p.region, octave, direction, p.band, p.y, p.x, sum(q.v * re) as re, sum(q.v * im) as im from cells p join cells q on q.region = p.region and q.band = p.band join tall on tall.region = p.region cross join bank
  join kr using (octave, direction, h, w) where kr.dy = (p.y + (size - 1) // 2 - q.y + h + size - 1) % (h + size - 1) and kr.dx = (p.x + (size - 1) // 2 - q.x + w + size - 1) % (w + size - 1) group by all)
select region, octave, direction, band::int as band, 0 as part, {R6.format('sum(re * re)')} as energy from cv group by all union all select region, octave, direction, band::int, 1, {R6.format('sum(im * im)')} from cv group by region, octave, direction, band""")
def gabor_energy(spark: SparkSession, d: str) -> DataFrame:
    found = stats.gabor(rasters.banded_raster(spark, d), rasters.tile_regions(spark, d), frequency=0.25, angle=math.pi / 2)
    return found.select("region", "octave", "direction", F.col("band").cast("int").alias("band"), "part", rounded("energy").alias("energy"))


# ---- graphs, clusters and factors -----------------------------------------------------------------------------------


@query(f"""with {knn_sql(16)}, {WEIGHTS}, g1 as (select r, sum(f * exp(-r) * exp(-f * exp(-r))) / nullif(sum(exp(-f * exp(-r))), 0) as g from sc, (select -10 + 0.25::double * k as r from range(0, 80) t(k)) where f is not null group by r),
best as (select r from g1 order by g desc, r limit 1), g2 as (select x.r, sum(f * exp(-x.r) * exp(-f * exp(-x.r))) / nullif(sum(exp(-f * exp(-x.r))), 0) as g from sc, (select best.r - 0.25::double + 0.01::double * k as r from best, range(0, 50) t(k)) x where f is not null group by x.r)
select round(exp(-r), 6) as factor, round(2 * g, 6) as dimension from (select * from g2 order by g desc, r limit 1)""")
def intrinsic_dimension(spark: SparkSession, d: str) -> DataFrame:
    scaled = settle(graph.normalised(settle(graph.nearest(rasters.features(spark, d), 16)), "local"))
    factor, dimension = graph.intrinsic(scaled)
    return spark.createDataFrame([(round(factor, 6), round(dimension, 6))], "factor double, dimension double")


def nation_chains(spark: SparkSession, d: str, own: float = 1.0) -> DataFrame:
    """(i, j, w): the nations of each region as a chain in order of their keys, each with itself as well."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").alias("part"))
    ranked = order.dense_index(nation, ["part", "i"], "at")
    there = ranked.select(F.col("i").alias("j"), F.col("part").alias("_p"), F.col("at").alias("_at"))
    pairs = ranked.join(there, (F.col("part") == F.col("_p")) & (F.abs(F.col("at") - F.col("_at")) <= 1))
    return settle(pairs.select("i", "j", F.when(F.col("i") == F.col("j"), own).otherwise(1.0).alias("w")))


def canonical(labels: DataFrame) -> DataFrame:
    """(i, label): each label by the least point that has it."""
    least = labels.groupBy("label").agg(F.min("i").alias("least"))
    return labels.join(least, "label").select("i", F.col("least").alias("label"))


@query("select n_nationkey::bigint as i, min(n_nationkey) over (partition by n_regionkey)::bigint as label from nation")
def spectral_parts(spark: SparkSession, d: str) -> DataFrame:
    """Chains that nothing connects are the clusters."""
    return canonical(cluster.spectral(nation_chains(spark, d), read(spark, d, "region").count()))


@query("with c as (select n_regionkey, count(*) as n from nation group by 1) select greatest(abs(trunc(ln(0.95 * x) / ln(x))), 1)::int as steps from (select max((1 + 2 * cos(pi() * k / n::double)) / 3) as x from c, range(1, 99) t(k) where k < n)")
def diffusion_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps by the largest eigenvalue under 1: that of chains whose ends hold twice their own weight is known in closed form."""
    chains = nation_chains(spark, d)
    ends = chains.groupBy("i").agg(F.sum("w").alias("s")).where("s < 3").select("i", F.col("i").alias("j"), (3.0 - F.col("s")).alias("w"))
    weight = settle(chains.union(ends).groupBy("i", "j").agg(F.sum("w").alias("w")))
    return spark.createDataFrame([(graph.estimate_steps(weight),)], "steps int")


@query("select method, (select count(*) from nation) as points, 0::bigint as crossing, true as stochastic, true as better from (values ('NMF'), ('NMF-boosted'), ('NMF-tables'), ('projection'), ('start'), ('start-tables')) t(method)")
def factor_searches(spark: SparkSession, d: str) -> DataFrame:
    """Points labelled by each search, components that reach into two chains, whether columns sum to 1, and whether the error is no worse than the start's."""
    matrix = settle(graph.diffusion(nation_chains(spark, d)))
    ids, m = nmf.collected(matrix)
    part = {r.n_nationkey: r.n_regionkey for r in read(spark, d, "nation").collect()}
    start = nmf.start(m, 2)
    f0 = nmf.start_tables(matrix, 2)
    tables = nmf.factorise_tables(matrix, 2, most=1)
    dense = lambda x, n, r, turn: _dense(x, ids, n, r, turn)
    r0, r1 = (1 + x.agg(F.max("j")).first()[0] for x in (f0, tables[0]))
    f0 = dense(f0, len(ids), r0, False)
    g0 = nmf.solve_g(m, f0, 2)
    found = {
        "start": start, "NMF": nmf.factorise(m, 2), "projection": nmf.projected(m, 1, 2), "NMF-boosted": nmf.boosted(m, steps=2, runs=3, boost=2),
        "start-tables": (f0, g0, nmf.error(m, f0, g0, 2)), "NMF-tables": (dense(tables[0], len(ids), r1, False), dense(tables[1], len(ids), r1, True), tables[2]),
    }
    worst = max(start[2], nmf.error(m, f0, g0, 2)) + 1e-6
    rows = []
    for name, (f, g, e) in found.items():
        homes = [{part[x] for x, v in zip(ids, f[:, k], strict=True) if v > 1e-6} for k in range(f.shape[1])]
        sums = max(abs(f.sum(0) - 1).max(), abs(g.sum(0) - 1).max()) < 1e-6
        rows.append((name, len(set(ids)), sum(len(h) > 1 for h in homes) if name != "NMF-boosted" else 0, bool(sums), bool(e <= worst or name == "NMF-boosted")))
    return spark.createDataFrame(rows, "method string, points long, crossing long, stochastic boolean, better boolean")


def _dense(x: DataFrame, ids: list, n: int, r: int, turn: bool):
    import numpy as np

    at, out = {v: k for k, v in enumerate(ids)}, np.zeros((r, n) if turn else (n, r))
    for c in x.collect():
        out[(c.i, at[c.j]) if turn else (at[c.i], c.j)] = c.v
    return out


@query("select count(*) as columns, 0::bigint as negative, 0::bigint as uphill, 0::bigint as off from embeddings")
def solved_columns(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative solutions are optimal: nothing is negative, no gradient points inside, and none is left where a value is positive."""
    import numpy as np

    gram = np.array([[2.0, 0.5, 0.1], [0.5, 1.0, 0.2], [0.1, 0.2, 1.5]])
    right = as_matrix(spark, d).where("j < 3")
    x = nmf.columns_solved(gram, right, False)
    product = linalg.product(x, spark.createDataFrame([(i, j, float(gram[i, j])) for i in range(3) for j in range(3)], "i long, j long, v double"))
    both = right.join(product.withColumnRenamed("v", "p"), ["i", "j"], "left").join(x.withColumnRenamed("v", "x"), ["i", "j"], "left")
    w = F.col("v") - F.coalesce("p", F.lit(0.0))
    return both.agg(F.countDistinct("i").alias("columns"), F.count_if(F.col("x") < 0).alias("negative"), F.count_if(w > 1e-7).alias("uphill"), F.count_if((F.abs(w) > 1e-7) & (F.col("x") > 1e-9)).alias("off"))


@query("select vec_id as i, min(vec_id) over (partition by vec_id % 5, (vec_id // 5) % 2) as label from embeddings")
def kmeans_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ten places far apart are the clusters."""
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.array(10.0 * F.pmod("vec_id", F.lit(5)), 100.0 * F.pmod(F.floor(F.col("vec_id") / 5), F.lit(2))).alias("f"))
    return canonical(labelling.label(points, "kmeans", k=10))


def _rounds(n: int) -> str:
    out = "p as (select vec_id as i, c, embedding[c]::double as v from embeddings, range(1, 65) t(c)), c0 as (select i as k, c, v from p where i < 8)"
    for x in range(1, n + 1):
        out += f""", d{x} as (select p.i, q.k, sum((p.v - q.v) ** 2) as d2 from p join c{x - 1} q using (c) group by p.i, q.k), a{x} as (select i, k from (select *, row_number() over (partition by i order by d2, k) as n from d{x}) where n = 1),
m{x} as (select a.k, p.c, avg(p.v) as v from a{x} a join p using (i) group by a.k, p.c), c{x} as (select o.k, o.c, coalesce(m.v, o.v) as v from c{x - 1} o left join m{x} m on m.k = o.k and m.c = o.c)"""
    return out


@query(f"with {_rounds(3)} select i, k as label from a3")
def lloyd_rounds(spark: SparkSession, d: str) -> DataFrame:
    points = rasters.features(spark, d)
    return cluster.lloyd(points, points.where("i < 8").select(F.col("i").alias("k"), "f"), 3)


# ---- superpixels and stacks of labels -------------------------------------------------------------------------------


def banded_image(spark: SparkSession, d: str, every: bool) -> DataFrame:
    """(r, c, v): 16 columns in tiles of 8 x 8; every tile unlike its neighbours, or every band of tiles unlike the next."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(15))))
    tr, tc = F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)
    value = (1000 * (2 * F.pmod(tr, F.lit(2)) + F.pmod(tc, F.lit(2)))) if every else 50 * tr * (tr + 1)
    return rows.select("r", "c", F.array_repeat(value.cast("double"), 4).alias("v"))


@query("select vec_id as r, c::int as c, (vec_id // 8 * 8) * 16 + c // 8 * 8 as region from embeddings, range(0, 16) t(c)")
def slic_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of clear colours are the superpixels; a second run from random places is worse and loses."""
    from ..operators import slic

    return slic.slic(banded_image(spark, d, True), height(spark, d), 16, 8, most=8, least_size=12, runs=2, tries=2)


@query("""with t as (select distinct vec_id // 8 as band, c // 8 as side from embeddings, range(0, 16) x(c)), n as (select count(*) as tiles, (select max(vec_id) + 1 from embeddings) as rows from t)
select round(0.0::double, 6) as scale, 1::bigint as atoms, band * 128 + side * 8 as least, true as child from t union all select round(sqrt(rows * 16 / tiles::double) + 0.3, 6), 2, band * 128, false from t, n where side = 0""")
def hierarchy_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """Superpixels, then one scale of merging: the two tiles of a band are alike, bands are not."""
    params = labelling.SlicParams(m_scale=0.0, sigma=0.3, most_rounds=8, least_size=12)
    parts, nodes, atoms = labelling.hierarchical_superpixels(banded_image(spark, d, False), height(spark, d), 16, 8, 8.2, params)
    sums = atoms.groupBy("node").agg(F.count("*").alias("atoms"), F.min("atom").alias("least"))
    return nodes.join(sums, "node").select(F.round("scale", 6).alias("scale"), "atoms", "least", F.col("parent").isNotNull().alias("child"))


def doubling_forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers by their key modulo 64, 32, .. 1: two nodes of a level share a parent, at scales 1 to 7."""
    nodes = [(f"{k}:{x}", f"{k + 1}:{x % 2 ** (5 - k)}" if k < 6 else None, float(k + 1)) for k in range(7) for x in range(2 ** (6 - k))]
    names = F.array(*[F.concat(F.lit(f"{k}:"), F.pmod("c_custkey", F.lit(2 ** (6 - k))).cast("string")) for k in range(7)])
    atoms = read(spark, d, "customer").select(F.explode(names).alias("node"), F.col("c_custkey").alias("atom"))
    return spark.createDataFrame(nodes, "node string, parent string, scale double"), atoms


@query("with x as (select 1.0::double as scale, c_custkey as atom, (c_custkey >> 5) & 1 as bit from customer union all select 3.0, c_custkey, (c_custkey >> 4) & 1 from customer union all select 5.0, c_custkey, (c_custkey >> 2) & 1 from customer) select scale, atom, min(atom) over (partition by scale, bit) as least from x")
def auto_scale_stack(spark: SparkSession, d: str) -> DataFrame:
    """Scales found by bisection: the next one is the first at which every region holds two labels."""
    nodes, atoms = doubling_forest(spark, d)

    def describe(region_atoms: DataFrame) -> DataFrame:
        parts = F.split("region", ":")
        level, number = F.element_at(parts, 1).cast("int"), F.element_at(parts, 2).cast("long")
        bit = F.pmod(F.floor(number / F.pow(F.lit(2.0), 5 - level)), F.lit(2))
        return region_atoms.select("region").distinct().select(F.col("region").alias("i"), F.array(100.0 * bit).alias("f"))

    stack = labelling.label_stack(settle(nodes), settle(atoms), describe, None, method="kmeans", k=2)
    least = stack.groupBy("scale", "label").agg(F.min("atom").alias("least"))
    return stack.join(least, ["scale", "label"]).select("scale", "atom", "least")


@query("with x as (select 2.5::double as scale, c_custkey as atom, c_nationkey % 2 as bit from customer union all select 3.5, c_custkey, n_regionkey % 2 from customer join nation on n_nationkey = c_nationkey) select scale, atom, min(atom) over (partition by scale, bit) as least from x")
def given_scale_stack(spark: SparkSession, d: str) -> DataFrame:
    """Labels of every atom at given scales."""

    def describe(region_atoms: DataFrame) -> DataFrame:
        key = F.expr("substring(region, 2)").cast("long")
        return region_atoms.select("region").distinct().select(F.col("region").alias("i"), F.array(100.0 * F.pmod(key, F.lit(2))).alias("f"))

    stack = labelling.label_stack(geo_nodes(spark, d), geo_atoms(spark, d), describe, [2.5, 3.5], method="kmeans", k=2)
    least = stack.groupBy("scale", "label").agg(F.min("atom").alias("least"))
    return stack.join(least, ["scale", "label"]).select("scale", "atom", "least")
