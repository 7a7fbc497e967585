"""Road graph and raster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions import geo
from trailspark.operators import graph, raster, snap
from trailspark.plans import adapters as A
from trailspark.tables import table

#: Hops of the search that has SQL to compare with.
HOPS = 6


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("cost").alias("least"))


def junctions(spark: SparkSession, d: str) -> DataFrame:
    return graph.junction_degree(A.edges(spark, d)).where("degree >= 3")


def components(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``road_components``, under its first name."""
    return road_components(spark, d)


def largest_component(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``largest_road_component``, under its first name."""
    return largest_road_component(spark, d)


def road_components(spark: SparkSession, d: str) -> DataFrame:
    """Size of each component of all roads, by its smallest node; a closure in SQL would grow with the square of a component."""
    return _sizes(A.edges(spark, d))


def largest_road_component(spark: SparkSession, d: str) -> DataFrame:
    """The largest component of all roads; the smallest label wins ties."""
    return _largest(road_components(spark, d))


def _sizes(edges: DataFrame) -> DataFrame:
    return graph.connected(edges).groupBy("label").agg(F.count("*").alias("nodes"))


def _largest(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.max_by("label", F.struct("nodes", -F.col("label"))).alias("label"), F.max("nodes").alias("nodes"))


def shortest_hops(spark: SparkSession, d: str) -> DataFrame:
    """Least cost from node 1 over at most six roads."""
    return graph.shortest(A.edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cost")), HOPS)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Least cost from nodes 1 and 2 to every node that they reach."""
    return graph.shortest(A.edges(spark, d), spark.range(1, 3).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("cost")))


def route_totals(spark: SparkSession, d: str) -> DataFrame:
    """Metres and real seconds of each order's legs: a leg's speed comes from its class, held by its cap."""
    speed = F.element_at(F.array(*[F.lit(float(v)) for v in (5, 20, 40, 60, 80, 90, 110, 128)]), (F.col("l_partkey") % 8 + 1).cast("int"))
    cap = F.element_at(F.array(*[F.lit(float(v)) for v in (1e9, 40, 25, 20)]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    metres = F.col("l_quantity") * 2.4 * F.pow(F.lit(2.0), (F.col("l_linenumber") % 8))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(metres), 3).alias("metres"), F.round(F.sum(metres / (F.least(speed, cap) / 3.6)), 3).alias("seconds"))


def point_on_line(spark: SparkSession, d: str) -> DataFrame:
    """Each place's nearest of four lines across the map, and where on it; the first segment wins ties."""
    lines = spark.createDataFrame([(i, -24.0 + 3 * i, 63.0 + 0.7 * i, -21.0 + 3 * i, 66.5 - 0.5 * i) for i in range(4)], "seg int, ax double, ay double, bx double, by double")
    p = A.places(spark, d).select("place_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return snap.nearest_segment(p, lines, "place_id", ["seg"], zoom=10).select("place_id", "seg", F.round("t", 6).alias("t"), "m")


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """Area by the shoelace formula of polygons made from orders' lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("x"), (F.col("l_suppkey") * 37 % 1000).alias("y"))
    whole = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    return p.groupBy("l_orderkey").agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"))


def raster_bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Heights at orders' places, all over the raster and a little beyond its last rows and columns."""
    heights = A.raster(spark, d)
    rows = heights.agg(F.max("row")).first()[0] + 1  # the raster's own extent
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % (rows * 10 + 5) / 10.0).alias("y"), (F.col("o_orderkey") * 11 % 393 / 10.0).alias("x"))
    return raster.bilinear(o, heights, rows, A.COLS).select("id", F.round("z", 3).alias("z"))


def terrain_rgb(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = raster.terrain_rgb(F.col("h"))
    return A.raster(spark, d).select("row", "col", r.alias("r"), g.alias("g"), b.alias("b"))


def overview_decimate(spark: SparkSession, d: str) -> DataFrame:
    return raster.decimated(A.raster(spark, d), 8)


def mosaic_extent(spark: SparkSession, d: str) -> DataFrame:
    return A.raster(spark, d).agg(F.min("row").alias("top"), (F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"), F.max("h").alias("highest"))


def best_insert(spark: SparkSession, d: str) -> DataFrame:
    """Between which stops of a route (an order's parts) a new stop costs least; the first gap wins ties."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_partkey").alias("p"))
    s = s.withColumn("q", F.lead("p").over(w)).withColumn("k", F.row_number().over(w) - 1).where("q is not null").withColumn("stop", F.col("l_orderkey") % 2000)
    detour = F.abs(F.col("p") - F.col("stop")) + F.abs(F.col("stop") - F.col("q")) - F.abs(F.col("p") - F.col("q"))
    return s.groupBy("l_orderkey").agg(F.min(F.struct(detour.alias("d"), "k")).alias("b")).select("l_orderkey", F.col("b.k").alias("gap"), F.col("b.d").alias("detour"))


QUERIES = {f.__name__: f for f in (in_degree, junctions, components, largest_component, road_components, largest_road_component, shortest_hops, shortest_path, route_totals, point_on_line, polygon_area, raster_bilinear, terrain_rgb, overview_decimate, mosaic_extent, best_insert)}

ORACLES = {
    "in_degree": f"with {A.EDGES} select dst as node, count(*) as n, min(cost) as least from edges group by dst",
    "junctions": f"with {A.EDGES}, b as (select src as node, dst as other from edges union select dst, src from edges) select node, count(*) as degree from b where node <> other group by node having count(*) >= 3",
    "shortest_hops": f"with recursive {A.EDGES}, walk as (select 1::bigint as node, 0::bigint as cost, 0 as hops union all select e.dst, w.cost + e.cost, hops + 1 from walk w join edges e on w.node = e.src where hops < {HOPS}) select node, min(cost) as cost from walk group by node",
    "route_totals": """with s as (select l_orderkey, l_quantity * 2.4 * pow(2, l_linenumber % 8) as m, least([5,20,40,60,80,90,110,128][l_partkey % 8 + 1], [1e9,40,25,20][l_suppkey % 4 + 1]) as v from lineitem)
select l_orderkey, round(sum(m), 3) as metres, round(sum(m / (v / 3.6)), 3) as seconds from s group by l_orderkey""",
    "point_on_line": f"""with {A.PLACES}, lines as (select i as seg, -24.0::double + 3 * i as ax, 63.0::double + 0.7::double * i as ay, -21.0::double + 3 * i as bx, 66.5::double - 0.5::double * i as "by" from range(4) r(i)),
m as (select place_id, seg, lon, lat, cos(radians(lat)) as k, (bx - ax) * cos(radians(lat)) as dx, "by" - ay as dy, (lon - ax) * cos(radians(lat)) as px, lat - ay as py from places, lines),
t as (select *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) as t from m), q as (select *, round({geo.DEGREE_M} * sqrt(pow(px - t * dx, 2) + pow(py - t * dy, 2)), 3) as m from t)
select place_id, seg::int as seg, round(t, 6) as t, m from q qualify row_number() over (partition by place_id order by m, seg) = 1""",
    "polygon_area": """with p as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 1000 as x, l_suppkey * 37 % 1000 as y from lineitem),
n as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from p window w as (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber))
select l_orderkey, abs(sum(x * ny - nx * y)) / 2.0 as area from n group by l_orderkey""",
    "raster_bilinear": f"""with {A.RASTER}, top as (select max(row) as top from raster), p as (select o_orderkey as id, top, (o_orderkey * 7919 % (top * 10 + 15)) / 10.0::double as y, (o_orderkey * 11 % 393) / 10.0::double as x from orders, top),
c as (select id, y between 0 and top and x between 0 and {A.COLS - 1} as inside, unnest([{{'r': least(floor(y) + a, top), 'c': least(floor(x) + b, {A.COLS - 1}), 'w': (case a when 0 then 1 - (y - floor(y)) else y - floor(y) end) * (case b when 0 then 1 - (x - floor(x)) else x - floor(x) end)}}]) as k from p, range(2) ra(a), range(2) rb(b))
select id, round(case when any_value(inside) then sum(k.w * coalesce(h, 0)) end, 3) as z from c left join raster on row = k.r and col = k.c group by id""",
    "terrain_rgb": f"with {A.RASTER}, v as (select row, col, round_even((greatest(h, 0) + 10000) * 10, 0)::bigint as v from raster) select row, col, (v >> 16) & 255 as r, (v >> 8) & 255 as g, v & 255 as b from v",
    "overview_decimate": f"with {A.RASTER} select row, col, h from raster where row % 8 = 0 and col % 8 = 0",
    "mosaic_extent": f"with {A.RASTER} select min(row) as top, max(row) - min(row) + 1 as rows, max(col) - min(col) + 1 as cols, max(h) as highest from raster",
    "best_insert": """with s as (select l_orderkey, l_partkey as p, lead(l_partkey) over w as q, row_number() over w - 1 as k, l_orderkey % 2000 as stop from lineitem window w as (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber)),
d as (select *, abs(p - stop) + abs(stop - q) - abs(p - q) as d from s where q is not null) select l_orderkey, k as gap, d as detour from d qualify row_number() over (partition by l_orderkey order by d, k) = 1""",
}
