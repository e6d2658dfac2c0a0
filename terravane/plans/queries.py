"""Named queries over the Parquet tables, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, scalar
from ..operators import cluster, filters, graph, hierarchy, linalg, merge, neighbours, nmf, order, regions, rle, slic, stats
from ..operators.stats import rounded
from ..sources import rasters, sinks
from ..sources.tables import read, settle
from . import labelling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import planted  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import planted  # noqa: F401  adds its own

    return dict(SQL)


# ---- views in SQL ---------------------------------------------------------------------------------------------------

PX = "px as (select vec_id as r, unnest(range(0, len(embedding)))::int as c, unnest(embedding)::double as v from embeddings)"
PB = PX + ", pb as (select r, (c // 4)::int as c, c % 4 as band, v from px)"
LABELS = "reg as (select vec_id as r, unnest(range(0, len(embedding)))::int as c, label::bigint as region from embeddings)"
TILES = "reg as (select r, c, (r // 8) * 8 + c // 8 as region from px)"
LINES = "lines as (select user_id as line, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type as value from events)"
RUNS = """marked as (select *, case when pos = 0 or value is distinct from lag(value) over (partition by line order by pos) then 1 else 0 end as n from lines),
runs as (select line, run_no, count(*) as run_length, any_value(value) as value from (select *, (sum(n) over (partition by line order by pos) - 1)::bigint as run_no from marked) group by line, run_no)"""
ADJACENT = """adj as (select distinct least(x, y) as a, greatest(x, y) as b from (
  select p.region as x, q.region as y from reg p join reg q on q.r = p.r and q.c = p.c + 1 union all
  select p.region, q.region from reg p join reg q on q.r = p.r + 1 and q.c = p.c) where x <> y)"""
STATS = "st as (select region, band, count(*) as n, sum(v) as s, sum(v * v) as ss, sum(r)::double as sr, sum(c)::double as sc from pb join reg using (r, c) group by all)"
COSTS = """one as (select region, max(n)::double as n, max(sr / n) as mr, max(sc / n) as mc, max(case when band = 0 then s / n end) as m0, max(case when band = 1 then s / n end) as m1,
  max(case when band = 2 then s / n end) as m2, max(case when band = 3 then s / n end) as m3 from st group by region),
cost as (select a, b, x.n * y.n / (x.n + y.n) * ((x.m0 - y.m0) ** 2 + (x.m1 - y.m1) ** 2 + (x.m2 - y.m2) ** 2 + (x.m3 - y.m3) ** 2
  + 0.3125::double * ((x.mr - y.mr) ** 2 + (x.mc - y.mc) ** 2)) as error from adj join one x on x.region = a join one y on y.region = b)"""


def knn_sql(k: int, offset: str = "0.0::double") -> str:
    p, q = offset.replace("ID", "p.vec_id"), offset.replace("ID", "q.vec_id")
    return f"""dist as (select q.vec_id as i, p.vec_id as j, {p} + sqrt(list_sum([(x[1]::double - x[2]::double) ** 2 for x in list_zip(q.embedding, p.embedding)])) + {q} as d
  from embeddings q, embeddings p),
knn as (select i, j, rank::int as rank, d * d as d2 from (select *, row_number() over (partition by i order by d, j) as rank from dist) where rank <= {k})"""


WEIGHTS = """good as (select coalesce(min(case when least > 0 then rank end), 1) as g, max(rank) as k from (select rank, min(d2) as least from knn group by rank)),
sig as (select i as n, sqrt(d2) as s from knn, good where rank = case when g + 6 <= k then g + 6 else k end),
sc as (select knn.*, d2 / nullif(a.s * b.s, 0) as f from knn join sig a on a.n = i join sig b on b.n = j)"""
PAIRED = "w as (select i, j, sum(w) as w from (select i, j, exp(-f) as w from sc union all select j, i, exp(-f) from sc) group by i, j)"
MATRIX = PAIRED + ", m as (select i, j, coalesce(w / nullif(sum(w) over (partition by j), 0), 0) as w from w)"
R6 = "round({}, 6) + 0.0::double"


def geo_nodes(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > customer as a forest: (node, parent, scale)."""
    region, nation, customer = (read(spark, d, t) for t in ("region", "nation", "customer"))
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    a = region.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(3.0).alias("scale"))
    b = nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(2.0))
    c = customer.select(name("c", "c_custkey"), name("n", "c_nationkey"), F.lit(1.0))
    return a.union(b).union(c)


def geo_atoms(spark: SparkSession, d: str) -> DataFrame:
    """(node, atom): the customers of every node."""
    both = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    return both.select(F.explode(names).alias("node"), F.col("c_custkey").alias("atom"))


GEO = """nodes as (select 'r' || r_regionkey as node, null::varchar as parent, 3.0::double as scale from region union all
  select 'n' || n_nationkey, 'r' || n_regionkey, 2.0 from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 1.0 from customer),
atoms as (select unnest(['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey]) as node, c_custkey as atom from customer join nation on c_nationkey = n_nationkey)"""


# ---- regions --------------------------------------------------------------------------------------------------------


@query(f"""with {PX}, {LABELS}, x as (select region, c as band, v from px join reg using (r, c)), mu as (select region, band, avg(v) as m from x group by all),
p as (select region, band, any_value(m) as m0, avg((v - m) ** 2) as m1, avg((v - m) ** 3) as m2 from x join mu using (region, band) group by all)
select region, band, 0 as moment, {R6.format('m0')} as value from p union all select region, band, 1, {R6.format('sign(m1) * abs(m1) ** (1.0::double / 2) / 2')} from p
union all select region, band, 2, {R6.format('sign(m2) * abs(m2) ** (1.0::double / 3) / 6')} from p""")
def region_moments(spark: SparkSession, d: str) -> DataFrame:
    values = rasters.line_raster(spark, d).join(rasters.label_regions(spark, d), ["r", "c"]).select("region", F.col("c").alias("band"), "v")
    return stats.moments(values, 3).withColumn("value", rounded("value"))


@query(f"with {LINES}, {RUNS} select * from runs")
def rle_encode(spark: SparkSession, d: str) -> DataFrame:
    return rle.encode(rasters.event_lines(spark, d)).withColumn("run_no", F.col("run_no").cast("long"))


@query(f"with {LINES} select * from lines")
def rle_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return rle.decode(rle.encode(rasters.event_lines(spark, d)))


@query(f"with {PX}, {TILES} select region, count(*) as n, string_agg(r || ':' || c, ',' order by r, c) as pixels from reg group by region")
def region_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    index = regions.inverted_index(rasters.tile_regions(spark, d))
    return index.withColumn("pixels", F.array_join(F.transform("pixels", lambda p: F.concat_ws(":", p["r"].cast("string"), p["c"].cast("string"))), ","))


@query(f'with {PX}, {TILES} select region, min(r) as top, min(c) as "left", max(r) as bottom, max(c) as "right" from reg group by region')
def region_bbox(spark: SparkSession, d: str) -> DataFrame:
    return regions.boxes(rasters.tile_regions(spark, d))


@query(f"with {PX}, {TILES} select r, c, region from reg where r = 0 and c = 9")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return regions.at_location(rasters.tile_regions(spark, d), 0, 9)


def compound(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping compound regions over the tiles: tile number modulo 5, and 100 + modulo 3."""
    atoms = rasters.tile_regions(spark, d).select(F.col("region").alias("atom")).distinct()
    return atoms.select(F.explode(F.array(F.pmod("atom", F.lit(5)), F.pmod("atom", F.lit(3)) + 100)).alias("region"), "atom")


COMPOUND = "ra as (select unnest([region % 5, region % 3 + 100]) as region, region as atom from (select distinct region from reg))"


@query(f"with {PX}, {TILES}, {COMPOUND} select distinct region from ra where atom = (select region from reg where r = 10 and c = 10)")
def regions_at_pixel(spark: SparkSession, d: str) -> DataFrame:
    return regions.compounds_at(rasters.tile_regions(spark, d), compound(spark, d), 10, 10)


@query(f"with {PX}, {TILES}, {COMPOUND} select ra.region, count(*) as n from ra join reg on atom = reg.region group by all")
def compound_pixels(spark: SparkSession, d: str) -> DataFrame:
    return regions.pixels_of(rasters.tile_regions(spark, d), compound(spark, d)).groupBy("region").agg(F.count("*").alias("n"))


@query(f"""with {PX}, {TILES}, b as (select region, min(r) as top, min(c) as lft from reg where region in (3, 11) group by region)
select region, r, c, r - top as tile_r, c - lft as tile_c, {R6.format('v')} as v from px join reg using (r, c) join b using (region)""")
def tile_fetch(spark: SparkSession, d: str) -> DataFrame:
    return regions.fetch(rasters.line_raster(spark, d), rasters.tile_regions(spark, d), [3, 11]).withColumn("v", rounded("v"))


@query(f"""with {PX}, {TILES}, mu as (select region, avg(v) as m from px join reg using (r, c) group by region)
select r, c, {R6.format('case when region % 2 = 0 then m else v end')} as v from px join reg using (r, c) join mu using (region)""")
def tile_assign(spark: SparkSession, d: str) -> DataFrame:
    pixels, tiles = rasters.line_raster(spark, d), rasters.tile_regions(spark, d)
    means = pixels.join(tiles, ["r", "c"]).groupBy("region").agg(F.avg("v").alias("new")).where(F.pmod("region", F.lit(2)) == 0)
    return regions.assign(pixels, tiles, means).withColumn("v", rounded("v"))


@query(f"with {PX}, {LABELS}, {ADJACENT} select * from adj")
def adjacency_pairs(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.adjacency(rasters.label_regions(spark, d))


@query(f"with {PB}, {TILES}, {STATS} select region, band, n, {R6.format('s')} as s, {R6.format('ss')} as ss, sr, sc from st")
def cluster_sufficient_stats(spark: SparkSession, d: str) -> DataFrame:
    found = stats.sufficient(rasters.banded_raster(spark, d), rasters.tile_regions(spark, d))
    return found.select("region", "band", "n", rounded("s").alias("s"), rounded("ss").alias("ss"), "sr", "sc")


@query(f"with {PB}, {TILES} select region, band, {R6.format('avg(v)')} as mean from pb join reg using (r, c) group by all")
def region_mean(spark: SparkSession, d: str) -> DataFrame:
    return stats.mean_values(rasters.banded_raster(spark, d), rasters.tile_regions(spark, d)).withColumn("mean", rounded("mean"))


def costs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tiles = rasters.tile_regions(spark, d).where("c < 16")
    edges = neighbours.adjacency(tiles)
    return edges, stats.merge_cost(edges, stats.sufficient(rasters.banded_raster(spark, d), tiles), 20.0, 8.0)


NARROW = "px0 as (select * from px where c < 16), reg as (select r, c, (r // 8) * 8 + c // 8 as region from px0)"


@query(f"with {PB}, {NARROW}, {ADJACENT}, {STATS}, {COSTS} select a, b, {R6.format('error')} as error from cost")
def merge_cost(spark: SparkSession, d: str) -> DataFrame:
    return costs(spark, d)[1].withColumn("error", rounded("error"))


@query(f"""with recursive {PB}, {NARROW}, {ADJACENT}, {STATS}, {COSTS}, cut as (select max(error) as e from (select error from cost order by error limit 20)),
two as (select a, b from cost, cut where error <= e union select b, a from cost, cut where error <= e), reach as (select a as n, a as m from two union select reach.n, two.b from reach join two on two.a = reach.m),
lab as (select n, min(m) as label from reach group by n),
kept as (select coalesce(x.label, a) as a, coalesce(y.label, b) as b from cost join cut on error > e left join lab x on x.n = a left join lab y on y.n = b)
select 'rename' as kind, n as a, label as b, 1 as times from lab union all
select 'edge', least(a, b), greatest(a, b), count(*)::int from kept where a <> b group by all""")
def merge_cutoff_round(spark: SparkSession, d: str) -> DataFrame:
    edges, error = costs(spark, d)
    labels, left, _ = merge.merge_round(edges, settle(error), 20)
    kept = left.groupBy("a", "b").agg(F.count("*").cast("int").alias("times"))
    return labels.select(F.lit("rename").alias("kind"), F.col("node").alias("a"), F.col("label").alias("b"), F.lit(1).alias("times")).union(kept.select(F.lit("edge"), "a", "b", "times"))


@query(f"with {LABELS} select region, count(*) as n, count(*) >= 3200 as active from reg group by region")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rasters.label_regions(spark, d).groupBy("region").agg(F.count("*").alias("n")).withColumn("active", F.col("n") >= 3200)


@query("select count(*) filter (where n_regionkey = n_nationkey) as active from nation")
def active_clusters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").agg(F.count_if(F.col("n_regionkey") == F.col("n_nationkey")).alias("active"))


@query(f"select l_suppkey, count(*) as n, {R6.format('sum(l_quantity * l_discount) / sum(l_quantity)')} as mean from lineitem group by l_suppkey")
def weighted_bincount(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), rounded(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("mean"))


@query(f"select vec_id as i, list_position(embedding, list_max(embedding))::int - 1 as at, {R6.format('list_max(embedding)::double')} as v from embeddings")
def label_argmax(spark: SparkSession, d: str) -> DataFrame:
    cells = rasters.features(spark, d).select("i", F.posexplode("f").alias("at", "v"))
    return stats.arg_extreme(cells, ["i"], "at", "v", True).withColumn("v", rounded("v"))


@query("select l_suppkey, l_orderkey, l_quantity from (select *, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey) as n from lineitem) where n = 1")
def argmin_ties(spark: SparkSession, d: str) -> DataFrame:
    return stats.arg_extreme(read(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", "l_quantity", False)


@query(f"with {PX}, {TILES}, lab as (select vec_id as r, label from embeddings) select min(n) as least from (select region, count(distinct label) as n from reg join lab using (r) group by region)")
def labels_per_superpixel_min(spark: SparkSession, d: str) -> DataFrame:
    labels = rasters.label_regions(spark, d).withColumnRenamed("region", "label")
    return stats.least_spread(rasters.tile_regions(spark, d).join(labels, ["r", "c"]))


@query("""with b as (select distinct event_type as bin from events), u as (select user_id, count(*) as total from events group by user_id)
select u.user_id as region, b.bin, round(count(e.event_id) / total::double, 6) as share from u cross join b left join events e on e.user_id = u.user_id and e.event_type = b.bin group by u.user_id, b.bin, total""")
def bin_count_descriptor(spark: SparkSession, d: str) -> DataFrame:
    values = read(spark, d, "events").select(F.col("user_id").alias("region"), F.col("event_type").alias("bin"))
    return stats.bin_counts(values, values.select("bin").distinct()).withColumn("share", rounded("share"))


@query(f"""with {PB}, {TILES}, a0 as (select region, band, v, r, c, '' as node from pb join reg using (r, c)),
c0 as (select region, node, avg(r) as mr, avg(c) as mc from a0 group by all),
a1 as (select region, band, v, r, c, node || case when r < mr and c >= mc then '1' when r < mr then '2' when c < mc then '3' else '4' end as node from a0 join c0 using (region, node)),
c1 as (select region, node, avg(r) as mr, avg(c) as mc from a1 group by all),
a2 as (select region, band, v, r, c, node || case when r < mr and c >= mc then '1' when r < mr then '2' when c < mc then '3' else '4' end as node from a1 join c1 using (region, node))
select region, node, band, {R6.format('avg(v)')} as value from a0 group by all union all select region, node, band, {R6.format('avg(v) / 4')} from a1 group by region, node, band
union all select region, node, band, {R6.format('avg(v) / 16')} from a2 group by region, node, band""")
def quadtree_descriptor_l3(spark: SparkSession, d: str) -> DataFrame:
    return stats.quadtree(rasters.banded_raster(spark, d), rasters.tile_regions(spark, d), 3).withColumn("value", rounded("value"))


@query(f"""with {PX}, {TILES} select region, n, (sum(n) over (order by region) - n)::bigint as before from (select region, count(*) as n from reg group by region)""")
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    counts = rasters.tile_regions(spark, d).groupBy("region").agg(F.count("*").alias("n"))
    return order.running_sum(counts, ["region"], "n", "upto").select("region", "n", (F.col("upto") - F.col("n")).alias("before"))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as index from orders")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return order.dense_index(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "index")


SWEEP = """k{1} as (select * from {0} where region not in (3, 7)), o{1} as (select h.r, h.c, h.region as old, coalesce(u.region, w.region, l.region, t.region) as new from {0} h
  left join k{1} u on u.r = h.r - 1 and u.c = h.c left join k{1} w on w.r = h.r + 1 and w.c = h.c left join k{1} l on l.r = h.r and l.c = h.c - 1 left join k{1} t on t.r = h.r and t.c = h.c + 1
  where h.region in (3, 7)), f{1} as (select * from k{1} union all select r, c, coalesce(new, old) from o{1})"""


@query(f"with {LABELS}, {SWEEP.format('reg', 1)}, {SWEEP.format('f1', 2)} select r, c, region from f2")
def hole_fill_fixed(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([(3,), (7,)], "region long")
    return neighbours.fill_sweep(neighbours.fill_sweep(rasters.label_regions(spark, d), gone), gone).select("r", "c", "region")


@query("""with n as (select n_nationkey, n_regionkey, min(c_custkey) as least from nation left join customer on c_nationkey = n_nationkey group by all),
r as (select n_regionkey, coalesce(min(least), min(n_nationkey) + 1000000000)::bigint as label from n group by 1)
select c_custkey as node, label from customer join nation on n_nationkey = c_nationkey join r using (n_regionkey) union all
select n_nationkey::bigint + 1000000000, label from n join r using (n_regionkey) union all select n_regionkey::bigint + 2000000000, label from r""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers to their nations, nations to their regions."""
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_nationkey").cast("long") + 1000000000).alias("b"))
    nations = read(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 1000000000).alias("a"), (F.col("n_regionkey").cast("long") + 2000000000).alias("b"))
    return neighbours.least_labels(customers.union(nations))


@query(f"""with {LABELS}, rows_ as (select distinct r, region from reg), g as (select r, region, r - row_number() over (partition by region order by r) as part from rows_),
s as (select region, part, min(r) * 64 as label from g group by all) select reg.r, reg.c, reg.region, s.label from reg join g on g.r = reg.r join s on s.region = g.region and s.part = g.part""")
def relabel_connected(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.relabel(rasters.label_regions(spark, d), 64)


@query(f"with {PX}, {TILES} select distinct region % 5 as region, region as atom from reg")
def compose_regions(spark: SparkSession, d: str) -> DataFrame:
    atoms = rasters.tile_regions(spark, d).select("region", F.col("region").alias("atom")).distinct()
    return regions.compose(atoms, atoms.select("region", F.pmod("region", F.lit(5)).alias("cluster")))


@query(f"with {PX}, {TILES}, t as (select distinct region from reg) select region % 5 as region, region % 3 + 100 as other, count(*) as n from t group by all")
def compound_overlap(spark: SparkSession, d: str) -> DataFrame:
    both = compound(spark, d)
    return regions.overlap(both.where("region < 100"), both.where("region >= 100"))


@query(f"with {PX}, {TILES}, {COMPOUND} select region, string_agg(atom, ',' order by atom) as atoms, count(*) as n from ra where region >= 100 group by region")
def export_raw(spark: SparkSession, d: str) -> DataFrame:
    ra = compound(spark, d)
    keys = ra.where("region >= 100").select("region")
    raw = regions.export(regions.submap(ra, keys), ra.groupBy("region").agg(F.count("*").alias("n")))
    again = regions.export(regions.from_raw(raw)).join(raw.select("region", "n"), "region")
    return again.select("region", F.array_join(F.transform("atoms", lambda x: x.cast("string")), ",").alias("atoms"), "n")


@query(f"with {PX}, {TILES} select r, string_agg(region, ', ' order by c) as line from reg group by r")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.raster_lines(rasters.tile_regions(spark, d), "region")


@query(f"""with {PX}, {TILES} select r, string_agg((region * 2654435761) % 256 || ' ' || ((region * 2654435761) >> 8) % 256 || ' ' || ((region * 2654435761) >> 16) % 256, ' ' order by c) as line from reg group by r""")
def picture_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.picture_lines(rasters.tile_regions(spark, d))


# ---- hierarchies ----------------------------------------------------------------------------------------------------


@query(f"with {GEO} select distinct scale from nodes")
def scales(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.scales(geo_nodes(spark, d))


@query("select 2.0::double as scale")
def nearest_scale(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.nearest_scale(geo_nodes(spark, d), 2.2)


@query(f"""with {GEO}, q as (select n.* from nodes n left join nodes p on p.node = n.parent
  where (n.scale < 2.5 or n.node not in (select parent from nodes where parent is not null)) and (p.node is null or p.scale >= 2.5))
select q.node as region, count(*) as orders, round(sum(o_totalprice), 4) as total from q join atoms using (node) join orders on o_custkey = atom group by 1""")
def cut_at_scale(spark: SparkSession, d: str) -> DataFrame:
    cut = hierarchy.cut_atoms(geo_nodes(spark, d), geo_atoms(spark, d), 2.5)
    return cut.join(read(spark, d, "orders"), F.col("o_custkey") == F.col("atom")).groupBy("region").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query("""with m as (select 2.0::double as scale, c_nationkey::bigint as rep, c_custkey as atom from customer union all select 3.0, n_regionkey, c_custkey from customer join nation on n_nationkey = c_nationkey),
way as (select scale, atom, scale || ':' || rep as node from m union all select 0.0, c_custkey, 'atom:' || c_custkey from customer),
up as (select *, lead(node) over (partition by atom order by scale, node) as parent from way) select node, min(parent) as parent, any_value(scale) as scale from up group by node""")
def hierarchy_build(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    merges = both.select(F.lit(2.0).alias("scale"), F.col("c_nationkey").cast("long").alias("rep"), F.col("c_custkey").alias("atom")).union(both.select(F.lit(3.0), F.col("n_regionkey").cast("long"), "c_custkey"))
    return hierarchy.build(merges, both.select(F.col("c_custkey").alias("atom")))


@query("""with p as (select n_regionkey::varchar as a, n_regionkey || '/' || n_nationkey as b from customer join nation on n_nationkey = c_nationkey)
select a as node, null::varchar as parent, 3.0::double as scale, count(*) as n from p group by a union all select b, any_value(a), 2.0, count(*) from p group by b""")
def hierarchy_from_stack(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    stack = both.select(F.lit(3.0).alias("scale"), F.col("c_custkey").alias("atom"), F.col("n_regionkey").alias("label")).union(both.select(F.lit(2.0), "c_custkey", "n_nationkey"))
    return hierarchy.from_stack(stack, [3.0, 2.0])


@query(f"""with recursive {GEO}, k as (select node from nodes where node in ('r1', 'n5') or (scale = 2 and parent = 'r1') or (scale = 1 and substr(node, 2)::bigint % 7 = 0)),
up as (select k.node, nodes.parent as above from k join nodes using (node) where parent is not null union select up.node, nodes.parent from up join nodes on nodes.node = up.above where nodes.parent is not null)
select node from k where node not in (select up.node from up where above in (select node from k))""")
def submap_roots(spark: SparkSession, d: str) -> DataFrame:
    nodes = geo_nodes(spark, d)
    keys = nodes.where(F.col("node").isin("r1", "n5") | ((F.col("scale") == 2) & (F.col("parent") == "r1")) | ((F.col("scale") == 1) & (F.pmod(F.expr("substring(node, 2)").cast("long"), F.lit(7)) == 0)))
    return hierarchy.roots_of(nodes, keys)


# ---- filters and colours --------------------------------------------------------------------------------------------


def flat(spark: SparkSession, d: str) -> DataFrame:
    return rasters.line_raster(spark, d).withColumn("band", F.lit(0)).select("r", "c", "band", "v")


def height(spark: SparkSession, d: str) -> int:
    return read(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1


GAUSS = "g as (select x::int as x, exp(-(x * x) / 2.0::double) as w from range(-3, 4) t(x))"


@query(f"with {PX}, {GAUSS} select p.r, p.c, 0 as band, {R6.format('sum(w * q.v) / sum(w)')} as v from px p cross join g join px q on q.r = p.r and q.c = p.c + g.x group by p.r, p.c")
def gaussian_blur_1d(spark: SparkSession, d: str) -> DataFrame:
    kernel = [(0, x, w) for x, w in filters.gaussian(1.0)]
    return filters.convolve(flat(spark, d), kernel, height(spark, d), 64).withColumn("v", rounded("v"))


@query(f"""with {PX}, {GAUSS}, h as (select p.r, p.c, sum(w * q.v) / sum(w) as v from px p cross join g join px q on q.r = p.r and q.c = p.c + g.x group by p.r, p.c)
select p.r, p.c, 0 as band, {R6.format('sum(w * q.v) / sum(w)')} as v from h p cross join g join h q on q.c = p.c and q.r = p.r + g.x group by p.r, p.c""")
def gaussian_blur_2d_separable(spark: SparkSession, d: str) -> DataFrame:
    kernel = filters.gaussian(1.0)
    return filters.separable(flat(spark, d), kernel, kernel, height(spark, d), 64).withColumn("v", rounded("v"))


@query(f"""with {PX}, o as (select a, b from range(-1, 2) s(a), range(-1, 2) t(b)) select p.r, p.c, 0 as band, {R6.format('sum(q.v) / 9')} as v
from px p cross join o join px q on q.r = p.r + o.a and q.c = p.c + o.b group by p.r, p.c""")
def box_conv_2d(spark: SparkSession, d: str) -> DataFrame:
    kernel = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return filters.convolve(flat(spark, d), kernel, height(spark, d), 64, "zero").withColumn("v", rounded("v"))


def wide_pixels(spark: SparkSession, d: str) -> DataFrame:
    """(r, c, v): pixels whose four bands are an array."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(F.col("embedding").cast("array<double>"), k * 4 + 1, F.lit(4)))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode(parts).alias("c", "v"))


PW = "pw as (select vec_id as r, k::int as c, [x::double for x in embedding[k * 4 + 1:k * 4 + 4]] as v from embeddings, range(0, 16) t(k))"
_LIN = "case when x{0} > 0.04045::double then ((x{0} + 0.055::double) / 1.055::double) ** 2.4::double else x{0} / 12.92::double end as l{0}"
_F = "case when {0} > 0.008856::double then {0} ** (1.0::double / 3) else 7.787::double * {0} + 16.0::double / 116 end"


@query(f"""with {PW}, u as (select r, c, (v[1] + 1) / 2 as x0, (v[2] + 1) / 2 as x1, (v[3] + 1) / 2 as x2 from pw), l as (select r, c, {', '.join(_LIN.format(k) for k in range(3))} from u),
z as (select r, c, {', '.join(f'({m[0]}::double * l0 + {m[1]}::double * l1 + {m[2]}::double * l2) / {w}::double as z{k}' for k, (m, w) in enumerate(zip(colour.TO_XYZ, colour.WHITE, strict=True)))} from l),
f as (select r, c, {', '.join(_F.format(f'z{k}') + f' as f{k}' for k in range(3))} from z)
select r, c, {R6.format('116 * f1 - 16')} as l, {R6.format('500 * (f0 - f1)')} as a, {R6.format('200 * (f1 - f2)')} as b from f""")
def rgb_to_lab(spark: SparkSession, d: str) -> DataFrame:
    x = [(F.element_at("v", k) + 1.0) / 2.0 for k in (1, 2, 3)]
    return wide_pixels(spark, d).select("r", "c", *[rounded(c).alias(n) for c, n in zip(colour.lab(*x), "lab", strict=True)])



# ---- graphs and matrices --------------------------------------------------------------------------------------------


@query(f"with {knn_sql(8)} select i, j, rank, {R6.format('d2')} as d2 from knn")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest(rasters.features(spark, d), 8).withColumn("d2", rounded("d2"))


@query(f"with {knn_sql(5, '(ID % 3) * 0.1::double')} select i, j, rank, {R6.format('d2')} as d2 from knn")
def knn_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    points = rasters.features(spark, d).withColumn("offset", F.pmod("i", F.lit(3)) * F.lit(0.1))
    return graph.nearest(points, 5).withColumn("d2", rounded("d2"))


def local_weights(spark: SparkSession, d: str, k: int = 16) -> DataFrame:
    return graph.weights(graph.normalised(settle(graph.nearest(rasters.features(spark, d), k)), "local"), 1.0)


@query(f"with {knn_sql(16)}, {WEIGHTS}, {MATRIX} select i, j, {R6.format('w')} as w from w")
def similarity_weights_local(spark: SparkSession, d: str) -> DataFrame:
    return local_weights(spark, d).withColumn("w", rounded("w"))


@query(f"with {knn_sql(16)}, g as (select avg(d2) as m from knn where rank = 2), sc as (select i, j, d2 / m as f from knn, g), {PAIRED} select i, j, {R6.format('w')} as w from w")
def similarity_weights_global(spark: SparkSession, d: str) -> DataFrame:
    knn = settle(graph.nearest(rasters.features(spark, d), 16))
    return graph.weights(graph.normalised(knn, "global"), 1.0).withColumn("w", rounded("w"))


@query(f"with {knn_sql(16)}, {WEIGHTS}, {MATRIX} select i, j, {R6.format('w')} as w from m")
def diffusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return graph.diffusion(local_weights(spark, d)).withColumn("w", rounded("w"))


HEAT = "h0 as (select 0::bigint as i, 1.0::double as v), h1 as (select m.i, sum(w * v) as v from m join h0 on h0.i = m.j group by m.i), h2 as (select m.i, sum(w * v) as v from m join h1 on h1.i = m.j group by m.i)"


@query(f"with {knn_sql(16)}, {WEIGHTS}, {MATRIX}, {HEAT} select i, 0 as comp, round(v, 8) as v from h2")
def diffuse_heat(spark: SparkSession, d: str) -> DataFrame:
    heat = spark.createDataFrame([(0, 0, 1.0)], "i long, comp int, v double")
    return graph.power_times(settle(graph.diffusion(local_weights(spark, d))), heat, 2.5).withColumn("v", F.round("v", 8))


@query(f"""with {knn_sql(16)}, {WEIGHTS}, grid as (select -10 + 0.25::double * k as r from range(0, 80) t(k)),
p as (select r, f, exp(-f * exp(-r)) as e from sc, grid where f is not null) select r, round(sum(f * exp(-r) * e) / nullif(sum(e), 0), 6) + 0.0::double as g from p group by r""")
def intrinsic_dim_grid(spark: SparkSession, d: str) -> DataFrame:
    scaled = graph.normalised(settle(graph.nearest(rasters.features(spark, d), 16)), "local")
    return graph.dimension_grid(scaled).withColumn("g", rounded("g"))


@query(f"with {PX}, {knn_sql(8)}, {WEIGHTS}, {MATRIX} select m.i, px.c as comp, round(sum(w * v), 6) + 0.0::double as v from m join px on px.r = m.j group by all")
def spmv(spark: SparkSession, d: str) -> DataFrame:
    matrix = graph.diffusion(local_weights(spark, d, 8))
    columns = rasters.line_raster(spark, d).select(F.col("r").alias("i"), F.col("c").alias("comp"), "v")
    return graph.times(matrix, columns).withColumn("v", rounded("v"))


def as_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rasters.line_raster(spark, d).select(F.col("r").alias("i"), F.col("c").alias("j"), "v")


@query(f"with {PX} select a.c as i, b.c as j, {R6.format('sum(a.v * b.v)')} as v from px a join px b using (r) group by all")
def gemm(spark: SparkSession, d: str) -> DataFrame:
    m = as_matrix(spark, d)
    return linalg.product(linalg.transpose(m), m).withColumn("v", rounded("v"))


@query(f"with {PX} select 0 as axis, c::bigint as index, {R6.format('sum(v)')} as total from px group by c union all select 1, r, {R6.format('sum(v)')} from px group by r")
def axis_sum(spark: SparkSession, d: str) -> DataFrame:
    m = as_matrix(spark, d)
    parts = [linalg.axis_sum(m, a).select(F.lit(a).alias("axis"), F.col("index").cast("long").alias("index"), rounded("total").alias("total")) for a in (0, 1)]
    return parts[0].union(parts[1])


@query(f"with {PX} select c as index, {R6.format('sum(v * v * (r % 3))')} as total from px group by c")
def axis_sum_product(spark: SparkSession, d: str) -> DataFrame:
    m = as_matrix(spark, d)
    return linalg.axis_sum_product(m, m.withColumn("v", F.col("v") * F.pmod("i", F.lit(3))), 0).withColumn("total", rounded("total"))


def factors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fixed positive factors (n x 3, 3 x n) of the descriptors' graph."""
    ids = read(spark, d, "embeddings").select(F.col("vec_id").alias("n")).withColumn("k", F.explode(F.array(*[F.lit(x).cast("long") for x in range(3)])))
    gamma = ids.select(F.col("n").alias("i"), F.col("k").alias("j"), (1.0 + F.pmod(F.col("n") * 7 + F.col("k") * 3, F.lit(5))).alias("v"))
    return gamma, ids.select(F.col("k").alias("i"), F.col("n").alias("j"), (1.0 + F.pmod(F.col("n") * 3 + F.col("k") * 5, F.lit(7))).alias("v"))


FACTORS = """ids as (select vec_id as n, k from embeddings, range(0, 3) t(k)), ga as (select n as i, k as j, 1.0::double + (n * 7 + k * 3) % 5 as v from ids),
de as (select k as i, n as j, 1.0::double + (n * 3 + k * 5) % 7 as v from ids),
f as (select i, j, v / sum(v) over (partition by j) as v from ga), g as (select i, j, v / sum(v) over (partition by j) as v from de),
mg as (select m.i, g.i as j, sum(w * v) as v from m join g on g.j = m.j group by all),
ff as (select a.j as i, b.j, sum(a.v * b.v) as v from f a join f b on a.i = b.i group by all), gg as (select a.i, b.i as j, sum(a.v * b.v) as v from g a join g b on a.j = b.j group by all)"""


@query(f"""with {knn_sql(8)}, {WEIGHTS}, {MATRIX}, {FACTORS}
select round((select sum(ff.v * gg.v) from ff join gg using (i, j)) - 2 * (select sum(f.v * mg.v) from f join mg using (i, j)), 8) as error""")
def nmf_error_term(spark: SparkSession, d: str) -> DataFrame:
    matrix = settle(graph.diffusion(local_weights(spark, d, 8)))
    f, g = (settle(nmf.normalised(x)) for x in factors(spark, d))
    powered = graph.power_times(matrix, g.select(F.col("j").alias("i"), F.col("i").alias("comp"), "v"), 1).select("i", F.col("comp").alias("j"), "v")
    return linalg.error_term(powered, f, g).withColumn("error", F.round("error", 8))


MOVED = """{0}s as (select j, sum(x.v) as n, sum(x.v * coalesce(y.v, 0)) as fix from {1} x left join {2} y using (i, j) group by j),
{0} as (select x.i, x.j, greatest(0, x.v + 10 * (coalesce(y.v, 0) / n - fix / n ** 2)) as v from {1} x left join {2} y using (i, j) join {0}s s on s.j = x.j)"""


@query(f"""with {knn_sql(8)}, {WEIGHTS}, {MATRIX}, {FACTORS}, fgg as (select f.i, gg.j, sum(f.v * gg.v) as v from f join gg on gg.i = f.j group by all), fg as (select i, j, mg.v - fgg.v as v from mg join fgg using (i, j)),
fm as (select f.j as i, m.j, sum(f.v * w) as v from f join m on m.i = f.i group by all), ffg as (select ff.i, g.j, sum(ff.v * g.v) as v from ff join g on g.i = ff.j group by all),
gd as (select i, j, coalesce(fm.v, 0) - ffg.v as v from ffg left join fm using (i, j)), {MOVED.format('newg', 'ga', 'fg')}, {MOVED.format('newd', 'de', 'gd')}
select 'gamma' as factor, i, j, {R6.format('v')} as v from newg union all select 'delta', i, j, {R6.format('v')} from newd""")
def nmf_gradient_step(spark: SparkSession, d: str) -> DataFrame:
    matrix = settle(graph.diffusion(local_weights(spark, d, 8)))
    gamma, delta = (settle(x) for x in factors(spark, d))
    new = nmf.gradient_step(matrix, gamma, delta, 1, 10.0)
    parts = [x.select(F.lit(n).alias("factor"), "i", "j", rounded("v").alias("v")) for n, x in zip(("gamma", "delta"), new, strict=True)]
    return parts[0].union(parts[1])


@query("""with p as (select vec_id as i, [x::double for x in embedding] as f from embeddings), d as (select p.i, c.i as k, list_sum([(x[1] - x[2]) ** 2 for x in list_zip(p.f, c.f)]) as d2 from p, p c where c.i < 8)
select i, k, round(d2, 6) + 0.0::double as d2 from (select *, row_number() over (partition by i order by d2, k) as n from d) where n = 1""")
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    points = rasters.features(spark, d)
    return cluster.lloyd_step(points, points.where("i < 8").select(F.col("i").alias("k"), "f"))[0].withColumn("d2", rounded("d2"))


CENTRES = """cen as (select (r // 8) * 4294967296 + c // 8 as k, avg(r) as r, avg(c) as c, avg(v[1]) as v1, avg(v[2]) as v2, avg(v[3]) as v3, avg(v[4]) as v4 from pw group by r // 8, c // 8)"""
ASSIGN = """s{1} as (select p.r, p.c, p.v, q.k, 400 * (((p.r - q.r) / 8.0::double) ** 2 + ((p.c - q.c) / 8.0::double) ** 2) + (v[1] - v1) ** 2 + (v[2] - v2) ** 2 + (v[3] - v3) ** 2 + (v[4] - v4) ** 2 as score from pw p
  join {0} q on abs(p.r // 8 - floor(q.r / 8)) <= 1 and abs(p.c // 8 - floor(q.c / 8)) <= 1 and abs(p.r - q.r) < 16 and abs(p.c - q.c) < 16),
a{1} as (select r, c, v, k, score from (select *, row_number() over (partition by r, c order by score, k) as n from s{1}) where n = 1)"""
MOVE = """u{1} as (select k, avg(r) as r, avg(c) as c, avg(v[1]) as v1, avg(v[2]) as v2, avg(v[3]) as v3, avg(v[4]) as v4 from a{1} group by k),
c{1} as (select k, coalesce(n.r, o.r) as r, coalesce(n.c, o.c) as c, coalesce(n.v1, o.v1) as v1, coalesce(n.v2, o.v2) as v2, coalesce(n.v3, o.v3) as v3, coalesce(n.v4, o.v4) as v4 from {0} o left join u{1} n using (k))"""


@query(f"with {PW}, {CENTRES}, {ASSIGN.format('cen', 1)} select r, c, k, {R6.format('score')} as score from a1")
def slic_assign(spark: SparkSession, d: str) -> DataFrame:
    pixels = wide_pixels(spark, d)
    return slic.assign(pixels, slic.grid_centres(pixels, 8), 8, 20).select("r", "c", "k", rounded("score").alias("score"))


@query(f"with {PW}, {CENTRES}, {ASSIGN.format('cen', 1)}, {MOVE.format('cen', 1)} select k, {R6.format('r')} as r, {R6.format('c')} as c, {R6.format('v1')} as v1, {R6.format('v4')} as v4 from c1")
def slic_center_update(spark: SparkSession, d: str) -> DataFrame:
    pixels = wide_pixels(spark, d)
    centres = settle(slic.grid_centres(pixels, 8))
    new = slic.update(slic.assign(pixels, centres, 8, 20), centres)
    return new.select("k", rounded("r").alias("r"), rounded("c").alias("c"), rounded(F.element_at("v", 1)).alias("v1"), rounded(F.element_at("v", 4)).alias("v4"))


@query(f"with {PW}, {CENTRES}, {ASSIGN.format('cen', 1)}, {MOVE.format('cen', 1)}, {ASSIGN.format('c1', 2)} select r, c, k, {R6.format('score')} as score from a2")
def slic_two_iterations(spark: SparkSession, d: str) -> DataFrame:
    pixels = wide_pixels(spark, d)
    centres = settle(slic.grid_centres(pixels, 8))
    centres = settle(slic.update(slic.assign(pixels, centres, 8, 20), centres))
    return slic.assign(pixels, centres, 8, 20).select("r", "c", "k", rounded("score").alias("score"))


@query("select k::int as k, round(30 * (2 / 30.0::double) ** (k / 5.0::double), 6) as scale from range(0, 5) t(k)")
def geometric_scales(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(scalar.geometric_scales(2.0, 30.0, levels=5))), "k int, scale double").withColumn("scale", F.round("scale", 6))


# ---- searches and descents, which SQL does not express --------------------------------------------------------------


@query()
def slic_full(spark: SparkSession, d: str) -> DataFrame:
    return slic.slic(wide_pixels(spark, d), height(spark, d), 16, 8, least_size=12)


@query()
def hslic_full(spark: SparkSession, d: str) -> DataFrame:
    pixels, rows = wide_pixels(spark, d), height(spark, d)
    atoms = settle(rasters.tile_regions(spark, d).where("c < 16"))
    merges = merge.multiscale(pixels.select("r", "c", F.posexplode("v").alias("band", "v")), atoms, rows, 16, 16.0)
    return hierarchy.build(settle(merges), atoms.select(F.col("region").alias("atom")).distinct())


@query()
def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelling.label(rasters.features(spark, d), "kmeans", k=10)


@query()
def spectral_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelling.label(rasters.features(spark, d), "spectral", labelling.GraphParams(knn=16, steps=3), k=10)


def dense_graph(spark: SparkSession, d: str) -> tuple[list, object]:
    """The graph of the region means of the tiles: as many rows as regions, not pixels."""
    means = stats.mean_values(rasters.banded_raster(spark, d), rasters.tile_regions(spark, d))
    points = means.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("band", "mean"))).alias("f")).select(F.col("region").alias("i"), F.transform("f", lambda x: x["mean"]).alias("f"))
    return nmf.collected(labelling.similarity(settle(points), labelling.GraphParams(knn=12, steps=3))[1])


@query()
def nmf_labels(spark: SparkSession, d: str) -> DataFrame:
    ids, m = dense_graph(spark, d)
    return nmf.labels_of(spark, ids, nmf.factorise(m, 3)[1])


@query()
def nmf_projection(spark: SparkSession, d: str) -> DataFrame:
    ids, m = dense_graph(spark, d)
    return nmf.labels_of(spark, ids, nmf.projected(m, 1, 3)[1])


@query()
def nmf_boosted(spark: SparkSession, d: str) -> DataFrame:
    ids, m = dense_graph(spark, d)
    return nmf.labels_of(spark, ids, nmf.boosted(m, steps=3)[1])


@query()
def label_map_stack(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("atom"), F.col("o_totalprice").alias("v"))

    def describe(atoms: DataFrame) -> DataFrame:
        f = F.array(F.log(F.avg("v")), F.log(F.stddev_pop("v") + 1))
        return atoms.join(orders, "atom").groupBy(F.col("region").alias("i")).agg(f.alias("f"))

    return labelling.label_stack(geo_nodes(spark, d), geo_atoms(spark, d), describe, [2.5, 3.5], method="kmeans", k=3)
