"""Joins by place: range joins on a grid, nearest neighbours on the sphere, as-of lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geo
from trailspark.tables import written


#: Tasks that a cell's left rows are dealt over.
_SHARES = 4


def bbox_join(left: DataFrame, right: DataFrame, cell: float, equal: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of rows whose boxes (l_ and r_ west, south, east, north) overlap, borders included.

    ``equal`` names pairs of columns, of left and right, that must be equal too.

    Both sides go to the grid cells that they cover; a pair counts only in the cell that holds the lower left corner
    of the overlap, so it comes once without a distinct. Costs grow with the cells a box covers: choose ``cell``
    about as large as a common box. Without ``equal`` few cells may hold most pairs, so a cell's left rows are dealt over _SHARES
    tasks, each with all of its right rows.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"{side}_{a}") / cell), F.floor(F.col(f"{side}_{b}") / cell)))
        return df.withColumn("_cx", span("west", "east")).withColumn("_cy", span("south", "north"))

    there = cells(right, "r").withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    on = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
    for a, b in equal or ():
        on = on & (F.col(a) == F.col(b))
    here = cells(left, "l")
    if not equal:
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: the sides are small, the pairs are many
        here = here.withColumn("_lp", F.pmod(F.xxhash64(*left.columns), F.lit(_SHARES)).cast("int")).repartition(tasks, "_cx", "_cy", "_lp")
        there = there.withColumn("_rp", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1)))).repartition(tasks, "_rx", "_ry", "_rp")
        on = on & (F.col("_lp") == F.col("_rp"))
    met = here.join(there, on)
    overlap = met.where("l_west <= r_east and r_west <= l_east and l_south <= r_north and r_south <= l_north")
    owner = (F.floor(F.greatest("l_west", "r_west") / cell) == F.col("_cx")) & (F.floor(F.greatest("l_south", "r_south") / cell) == F.col("_cy"))
    return overlap.where(owner).drop("_cx", "_cy", "_rx", "_ry", "_lp", "_rp")


def _unit(lon: str, lat: str) -> list[Column]:
    """A place as a point of the unit sphere. Straight lines between such points grow with the distance on the ground, and neither
    poles nor longitude 180 are special."""
    x, y = F.radians(lon), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


#: Targets that a target shares its cell with, on average; the octree is as deep as that takes, down to cells of 12 m.
_CROWD, _DEEPEST = 5, 20


def nearest(points: DataFrame, targets: DataFrame, key: str, tie: str, most_km: float | None = None, depth: int | None = None) -> DataFrame:
    """Each point (key, lon, lat, ...) with its nearest target (t_lon, t_lat, ...) on the sphere and km.

    Equal distances go to the smaller ``tie`` (a column of targets). Without ``most_km`` only rows with an unknown place are left
    out, or all if there is no target. key is unique.

    Places lie in the cells of an octree around the sphere, whose ``depth`` follows from how densely the targets lie unless given; of several at one
    place only the first counts. A point first meets the targets of its own cell and its neighbours, as one row; a find nearer than
    a cell is wide is final. The others go down the tree twice: along the boxes that seem nearest, which gives a bound,
    and then to all boxes within it, of which few are left, as the boxes fit the targets in a cell. So neither step holds a
    row for each pair of a point and a target around it.
    """
    axes = ("_x", "_y", "_z")
    cells = [f"_c{a}" for a in axes]
    value = [c for c in targets.columns if c != tie]

    def placed(df: DataFrame, lon: str, lat: str) -> DataFrame:
        return df.select("*", *[v.alias(n) for n, v in zip(axes, _unit(lon, lat))])

    def cell(v: Column, level: int) -> Column:
        return F.least(F.floor((v + 1.0) * (1 << level) / 2), F.lit((1 << level) - 1)).cast("long")

    rest = [c for c in value if c not in ("t_lon", "t_lat")]
    there = targets.where("t_lon is not null and t_lat is not null").groupBy("t_lon", "t_lat").agg(F.min(F.struct(tie, *rest)).alias("_b")).select("t_lon", "t_lat", "_b.*")
    there = written(placed(there, "t_lon", "t_lat").select("*", *[cell(F.col(a), _DEEPEST).alias(c) for a, c in zip(axes, cells)]))
    depth = depth or _depth(there, cells)
    up = lambda by: [F.shiftright(c, by).alias(c) for c in cells]
    size = 2.0 / (1 << depth)
    there = there.select(F.struct(tie, *value).alias("_t"), *axes, *up(_DEEPEST - depth))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file's points are work for many tasks
    here = placed(points.select(key, "lon", "lat").where("lon is not null and lat is not null").repartition(tasks, key), "lon", "lat")

    def best() -> Column:
        km = lambda t: geo.haversine_km(F.col("lon"), F.col("lat"), t["t_lon"], t["t_lat"])
        return F.array_min(F.transform("_ts", lambda t: F.struct(km(t).alias("km"), *[t[c].alias(c) for c in (tie, *value)])))

    around = there.select("_t", *cells)
    for c in cells:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + v for v in (-1, 0, 1)])))
    around = around.groupBy(*cells).agg(F.collect_list("_t").alias("_ts"))
    chord = lambda km: 2 * F.sin(F.least(km, F.lit(geo.SEARCH_KM * math.pi)) / (2 * geo.SEARCH_KM))
    seen = here.select("*", *[cell(F.col(a), depth).alias(c) for a, c in zip(axes, cells)]).join(around, cells, "left")
    seen = written(seen.withColumn("_b", best()).drop("_ts", *cells).withColumn("_d", chord(F.col("_b.km"))))
    sure = F.coalesce(F.col("_d") < size * (1 - 1e-9), F.lit(False))
    found = seen.where(sure).select(key, "_b")
    bound = F.lit(9.0) if most_km is None else chord(F.lit(float(most_km))) + 1e-9
    open_ = seen.where(~sure).select(key, "lon", "lat", *axes, F.least(F.coalesce("_d", F.lit(9.0)) + 1e-9, bound).alias("_ub"))
    if not open_.isEmpty():
        found = found.unionByName(_descended(open_, there, key, axes, cells, depth, best, chord))
    done = points.join(found, key).select("*", "_b.*").drop("_b")
    return done if most_km is None else done.where(F.col("km") <= most_km)


def _depth(there: DataFrame, cells: list[str]) -> int:
    """The least depth at which a target has no more than _CROWD targets in its cell, itself included, on average."""
    levels = there.select(F.explode(F.sequence(F.lit(2), F.lit(_DEEPEST))).alias("level"), *cells)
    levels = levels.select("level", *[F.expr(f"shiftright({c}, {_DEEPEST} - level)").alias(c) for c in cells])
    crowd = levels.groupBy("level", *cells).agg(F.count("*").alias("n")).groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"))
    return crowd.where(F.col("crowd") <= _CROWD).agg(F.min("level")).first()[0] or _DEEPEST


def _descended(open_: DataFrame, there: DataFrame, key: str, axes: tuple, cells: list[str], depth: int, best, chord) -> DataFrame:
    """The nearest target of each open point within its ``_ub``, down the tree of the boxes of longitude and latitude around the
    targets of a cell."""
    up = lambda by: [F.shiftright(c, by).alias(c) for c in cells]
    east, north, flat = F.atan2("_y", "_x"), F.atan2(F.col("_z"), F.hypot("_x", "_y")), F.hypot("_x", "_y")
    sides = [(F.min, "_w", east), (F.max, "_e", east), (F.min, "_s", north), (F.max, "_n", north)]
    boxes = written(there.groupBy(*cells).agg(*[f(v).alias(c) for f, c, v in sides]))
    steps = [*range(depth % 2 or 2, depth, 2), depth]

    def at(level: int) -> DataFrame:
        """Boxes of a level with the sines and cosines of their sides."""
        df = boxes.select(*up(depth - level), *[c for _, c, _ in sides]).groupBy(*cells).agg(*[f(c).alias(c) for f, c, _ in sides])
        return df.withColumn("_k", F.struct(*cells, "_w", "_e", *[f(c).alias(f"{c}{n}") for _, c, _ in sides for n, f in (("s", F.sin), ("c", F.cos))]))

    def kids(level: int, below: int) -> DataFrame:
        return at(below).select("_k", *up(below - level)).groupBy(*cells).agg(F.collect_list("_k").alias("_ks"))  # 64 cells at most

    def near_to(k: Column) -> Column:
        """The cosine of the angle from a point to the nearest place of a box."""
        x, y, z = (F.col(a) for a in axes)
        level = F.when((F.col("_l") >= k["_w"]) & (F.col("_l") <= k["_e"]), F.col("_r")).otherwise(F.greatest(x * k["_wc"] + y * k["_ws"], x * k["_ec"] + y * k["_es"]))
        ends = F.greatest(z * k["_ss"] + level * k["_sc"], z * k["_ns"] + level * k["_nc"])
        between = (z * k["_sc"] - level * k["_ss"] > 0) & (z * k["_nc"] - level * k["_ns"] < 0)
        return F.when(between, F.sqrt(z * z + level * level)).otherwise(ends)

    least = F.array_max(F.transform("_ks", lambda k: F.struct(near_to(k).alias("d"), *[k[c].alias(c) for c in cells])))
    within = F.explode(F.filter("_ks", lambda k: near_to(k) >= F.col("_least") - 1e-13))
    point = [key, "lon", "lat", *axes, "_l", "_r"]
    top = at(steps[0]).agg(F.collect_list("_k").alias("_ks"))  # one row of 64 cells at most
    leaves = there.groupBy(*cells).agg(F.collect_list("_t").alias("_ts"))

    near = open_.withColumn("_l", east).withColumn("_r", flat).join(F.broadcast(top)).select(*point, "_ub", least.alias("_k"))
    for level, below in zip(steps, steps[1:]):
        near = near.select(*point, "_ub", *[F.col(f"_k.{c}") for c in cells]).join(kids(level, below), cells).select(*point, "_ub", least.alias("_k"))
    near = near.select(*point, "_ub", *[F.col(f"_k.{c}") for c in cells]).join(leaves, cells)
    ub = F.least("_ub", chord(best()["km"]) + 1e-9)
    known = written(near.withColumn("_ub", ub).select(*point, (1 - F.col("_ub") * F.col("_ub") / 2).alias("_least")))

    near = known.join(F.broadcast(top)).select(*point, "_least", within.alias("_k"))
    for level, below in zip(steps, steps[1:]):
        near = near.select(*point, "_least", *[F.col(f"_k.{c}") for c in cells]).join(kids(level, below), cells).select(*point, "_least", within.alias("_k"))
    near = near.select(*point, *[F.col(f"_k.{c}") for c in cells]).join(leaves, cells)
    return near.select(key, best().alias("_b")).groupBy(key).agg(F.min("_b").alias("_b"))


def asof(left: DataFrame, right: DataFrame, on: list[str], by: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row of the same ``on`` whose ``by`` isn't beyond its own.

    One shuffle on the key and one sort; no range join. Right rows with equal ``by`` count in the order of values.
    """
    a = left.withColumn("_s", F.lit(0 if strict else 1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType))
    b = right.select(*on, by, F.lit(1 if strict else 0).alias("_s"), F.struct(*values).alias("_v"))
    both = a.withColumn("_left", F.lit(True)).unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(by, "_s", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return seen.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
