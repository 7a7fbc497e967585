"""Tracks laid on roads: which road each point is on, stretches of one road or trail, where they begin, and their times.

Nothing holds a whole track: points meet roads by cell, neighbours meet by windows, and what hangs on earlier
decisions along a track goes through ``folding.folded``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailspark.functions import geo
from trailspark.operators import folding, snap
from trailspark.tables import written

# Metres within which a point is on a road; the least stretch; bends that count, by degrees and metres apart; the share
# off the roads from which a track is walked; walking pace (m/s); the frame of a turn; caps by class and speeds by line type (km/h).
ON_ROAD_M = 20.0
MIN_STRETCH_M = 30.0
BEND_DEG = 50.0
BEND_GAP_M = 60.0
MOSTLY_TRAIL = 0.5
WALK_MPS = 4 / 3.6
FRAME_M = 30.0
CLASS_CAP_KMH = {1: 40.0, 2: 25.0, 3: 20.0}
TYPE_KMH = {0x01: 90, 0x02: 80, 0x03: 70, 0x04: 60, 0x05: 60, 0x06: 40, 0x07: 20, 0x08: 40, 0x09: 60, 0x0A: 40, 0x0B: 60, 0x0C: 30, 0x16: 4}
OTHER_KMH = 50.0


def in_order(by: str = "track", order: str = "n") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def along(points: DataFrame) -> DataFrame:
    """points (track, n, lon, lat) with ``along``, metres from the track's start."""
    w = in_order()
    step = F.coalesce(geo.plane_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("along", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def way(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Direction from one place to another in a plane at their mean latitude, 0 to 360."""
    k = F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * k, lat2 - lat1)), F.lit(360.0))


def turns(points: DataFrame) -> DataFrame:
    """points (track, n, lon, lat, along) with ``way_in`` over the last 30 m, ``way_out`` over the next 30 m, and ``turn``, right positive.

    The places 30 m back and ahead lie between points; near an end the first or last point stands for them. They come
    from frames by distance: the last point that lies that far back, and the one behind it.
    """
    spot = F.struct("along", "lon", "lat")
    marked = points.withColumn("_p", spot).withColumn("_next", F.lead(spot).over(in_order())).withColumn("_prev", F.lag(spot).over(in_order()))
    back = Window.partitionBy("track").orderBy("along").rangeBetween(Window.unboundedPreceding, -int(FRAME_M))
    # of places at one distance the one nearer along the track counts, so frames pick by n
    marked = marked.withColumn("_b", F.max(F.struct("n", F.col("_p").alias("far"), F.col("_next").alias("near"))).over(back))
    marked = marked.withColumn("_minus", -F.col("along"))
    ahead = Window.partitionBy("track").orderBy("_minus").rangeBetween(Window.unboundedPreceding, -int(FRAME_M))
    marked = marked.withColumn("_a", F.min(F.struct("n", F.col("_p").alias("far"), F.col("_prev").alias("near"))).over(ahead))
    ends = Window.partitionBy("track")
    marked = marked.withColumn("_first", F.min(F.struct("n", F.col("_p").alias("p"))).over(ends)["p"]).withColumn("_last", F.max(F.struct("n", F.col("_p").alias("p"))).over(ends)["p"])

    def between(frame: str, target: Column, end: str, c: str) -> Column:
        far, near = F.col(f"{frame}.far"), F.col(f"{frame}.near")
        span = far["along"] - near["along"]
        t = F.when(span == 0, 0.0).otherwise((target - near["along"]) / span)
        return F.when(F.col(frame).isNull(), F.col(end)[c]).otherwise(near[c] + (far[c] - near[c]) * t)

    target = {"_b": F.col("along") - FRAME_M, "_a": F.col("along") + FRAME_M}
    into = way(between("_b", target["_b"], "_first", "lon"), between("_b", target["_b"], "_first", "lat"), F.col("lon"), F.col("lat"))
    out = way(F.col("lon"), F.col("lat"), between("_a", target["_a"], "_last", "lon"), between("_a", target["_a"], "_last", "lat"))
    return marked.withColumn("way_in", into).withColumn("way_out", out).withColumn("turn", between_ways(F.col("way_in"), F.col("way_out"))).select(*points.columns, "way_in", "way_out", "turn")


def between_ways(into: Column, out: Column) -> Column:
    """Degrees from one direction to another, -180 up to below 180."""
    return F.pmod(out - into + 540.0, F.lit(360.0)) - 180.0


def _same(n: str | None = None) -> Column:
    """Rows of one track, and of one ``n`` of it, where the right side has them as _t and _n."""
    track = F.col("track").eqNullSafe(F.col("_t"))
    return track if n is None else track & (F.col(n) == F.col("_n"))


def on_roads(points: DataFrame, roads: DataFrame, zoom: int = 14) -> DataFrame:
    """points (track, n, lon, lat) with name, type and cls of the nearest road line within 20 m, and ``road``, which tells roads apart.

    roads: stretch, line, name, type, cls. Off the roads, road is ``trail``. Of equal distances the lesser stretch counts.
    """
    parts = snap.segments_of(roads.select("stretch", "line", "name", "type", "cls")).select("stretch", "seq", "name", "type", "cls", "ax", "ay", "bx", "by")
    asked = points.select(F.struct("track", "n").alias("_at"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = snap.nearest_segment(asked, parts, "_at", ["stretch", "seq"], zoom, ON_ROAD_M).select(F.col("_at.track").alias("_t"), F.col("_at.n").alias("_n"), "name", "type", "cls")
    road = F.when(F.col("_n").isNull(), "trail").otherwise(F.concat(F.coalesce("name", F.lit("")), F.lit("|"), F.coalesce(F.col("type").cast("string"), F.lit("0"))))
    joined = points.join(met, _same("n"), "left")
    return joined.withColumn("road", road).drop("_t", "_n")


def _steadied(hits: DataFrame) -> DataFrame:
    """Lone points that differ from both neighbours, which agree, go to the neighbours' road.

    A point that was moved holds its successor where it is, so of a chain of such points every other one moves.
    """
    w, values = in_order(), ["road", "name", "type", "cls"]
    lone = F.coalesce((F.lag("road").over(w) == F.lead("road").over(w)) & (F.col("road") != F.lag("road").over(w)), F.lit(False))
    chained = hits.withColumn("_lone", lone).withColumn("_chain", F.sum(F.when(F.col("_lone"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("track", "_chain").orderBy("n"))  # 1 is the point before the chain, unless the track begins with it
    moved = F.col("_lone") & (place % 2 == 0)
    chained = chained.withColumn("_moved", moved)
    return chained.select(*[c for c in hits.columns if c not in values], *[F.when(F.col("_moved"), F.lag(v).over(w)).otherwise(F.col(v)).alias(v) for v in values])


def _runs(points: DataFrame) -> DataFrame:
    """Runs of one road: track, run, n and along of its start, its road, after runs of less than 30 m joined those before."""
    w = in_order()
    starts = points.withColumn("_before", F.lag("road").over(w)).where("_before is null or _before <> road").drop("_before")
    ends = points.groupBy(F.col("track").alias("_t")).agg(F.max("along").alias("_end"))
    starts = starts.join(ends, _same())
    length = F.coalesce(F.lead("along").over(w), F.col("_end")) - F.col("along")
    kept = starts.withColumn("_m", length).withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) | (F.col("_m") >= MIN_STRETCH_M))
    merged = kept.withColumn("_before", F.lag("road").over(w)).where("_before is null or _before <> road")
    return merged.select("track", "n", "along", "road", "name", "type", "cls").withColumn("run", F.row_number().over(w))


def _moved_to_corners(runs: DataFrame, points: DataFrame) -> DataFrame:
    """Each run but a track's first begins at the sharpest point up to 40 m before, but behind the start of the run before.

    Each run is met by the points of those 40 m; of these only the ones that are sharper than all nearer to the run's start can
    be chosen, and a fold over the runs picks the last of them that lies behind the start before.
    """
    later = runs.where("run > 1").select(F.col("track").alias("_t"), "run", F.col("n").alias("start"), F.col("along").alias("start_m"))
    cell = lambda c: F.floor(c / (2 * ON_ROAD_M))
    later = later.withColumn("_cell", F.explode(F.array(cell(F.col("start_m")), cell(F.col("start_m")) - 1)))
    p = points.select("track", "n", "along", F.abs("turn").alias("sharp")).withColumn("_cell", cell(F.col("along")))
    met = later.join(p.withColumnRenamed("_cell", "_of"), _same() & (F.col("_cell") == F.col("_of"))).where("n <= start and start_m - along <= 40")
    w = Window.partitionBy("_t", "run").orderBy(F.desc("n"))
    sharper = F.coalesce(F.col("sharp") > F.max("sharp").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    records = met.withColumn("_new", sharper).where("_new").groupBy("_t", "run").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns"))  # sharper each time: few
    all_runs = runs.join(records.withColumnRenamed("run", "_n"), _same("run"), "left").select("track", "run", "n", "ns")

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        (before,) = state
        out = []
        for run, n, ns in zip(rows["run"], rows["n"], rows["ns"]):
            start = n if before is None else next((x for x in reversed(ns or [n]) if x == n or x > before), n)
            out.append((run, start))
            before = start
        return (before,), out

    moved = folding.folded(all_runs, "track", ["run"], (None,), step, "run int, n long")
    again = moved.select(F.col("track").alias("_t"), F.col("run").alias("_n"), F.col("n").alias("_start"))
    return runs.join(again, _same("run")).select("track", "run", F.col("_start").alias("n"), "road", "name", "type", "cls")


def _bends(runs: DataFrame, points: DataFrame) -> DataFrame:
    """track, n of the bends of trails: at least 50 degrees, no sharper just behind, 60 m from the last and the run's start, 30 m from its end."""
    sharp = F.abs("turn")
    marked = points.withColumn("_sharper", F.coalesce(F.abs(F.lead("turn").over(in_order())) > sharp, F.lit(False)))
    spans = _spans(runs, points)
    behind = marked.join(spans.select(F.col("track").alias("_t"), F.col("n").alias("_n"), F.lit(True).alias("_starts"), F.col("along").alias("_from"), F.col("until").alias("_until"), F.col("road").alias("_road")), _same("n"), "left")
    w = in_order().rowsBetween(Window.unboundedPreceding, 0)
    held = behind.select("track", "n", "along", sharp.alias("sharp"), "_sharper", F.coalesce("_starts", F.lit(False)).alias("starts"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("_from", "_until", "_road")])
    asked = held.where("_road = 'trail' and not starts and sharp >= 50 and not _sharper and _until - along >= 30")

    def step(state: tuple, rows: dict[str, list]) -> tuple[tuple, list]:
        run, last = state
        out = []
        for n, at, begin in zip(rows["n"], rows["along"], rows["_from"]):
            if run != begin:
                run, last = begin, begin
            if at - last >= BEND_GAP_M:
                out.append((n,))
                last = at
        return (run, last), out

    return folding.folded(asked.select("track", "n", "along", "_from"), "track", ["n"], (None, 0.0), step, "n long")


def _spans(starts: DataFrame, points: DataFrame) -> DataFrame:
    """starts (track, n) with along and time there, and until and until_time of the next start or the track's last point."""
    w = in_order()
    at = points.select(F.col("track").alias("_t"), F.col("n").alias("_n"), "along", "time")  # starts has neither
    ends = points.groupBy(F.col("track").alias("_t")).agg(F.max(F.struct("n", "along", "time")).alias("_end"))
    met = starts.join(at, _same("n")).drop("_t", "_n").join(ends, _same()).drop("_t")
    return met.withColumn("until", F.coalesce(F.lead("along").over(w), F.col("_end.along"))).withColumn("until_time", F.when(F.lead("n").over(w).isNotNull(), F.lead("time").over(w)).otherwise(F.col("_end.time"))).drop("_end")


def match(points: DataFrame, roads: DataFrame, zoom: int = 14) -> DataFrame:
    """The stretches of each track: track, n (of the first point), name, type, junction, trail, bend, highland, metres, seconds.

    points: track, n (whole numbers, unique in a track), lon, lat and time (milliseconds, may be null); rows without a place take no
    part. roads: stretch, line, name, type, cls. A track of one point gives one trail stretch of no length; a null track is a track.

    A point is on the nearest road line within 20 m. Lone points that differ go to their neighbours' road; runs of
    less than 30 m join the run before; a change of road moves back to the sharpest point of the 40 m before; trails are
    cut at their bends. Seconds come from the track's times where it has them at both ends, the last later, and at the
    stretch's; else at walking pace on trails, or all along if more than half of the track is trail; else by the road's type
    and class, as the point at which the stretch begins has it.
    """
    known = points.select("track", F.col("n").cast("long").alias("n"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("time").cast("long").alias("time")).where("lon is not null and lat is not null")
    known = written(known)
    hits = _steadied(turns(along(on_roads(known, roads, zoom))))  # roads first, while rows are short; then all goes by track
    alone = F.lag("n").over(in_order()).isNull() & F.lead("n").over(in_order()).isNull()
    hits = hits.withColumn("_alone", alone).select(*known.columns, "along", "turn", F.when(F.col("_alone"), "trail").otherwise(F.col("road")).alias("road"), *[F.when(~F.col("_alone"), F.col(c)).alias(c) for c in ("name", "type", "cls")])
    hits = written(hits)
    runs = written(_moved_to_corners(_runs(hits), hits))
    bends = _bends(runs, hits).select("track", "n", F.lit("trail").alias("road"), F.lit(True).alias("bend"))
    starts = runs.withColumn("bend", F.lit(False)).unionByName(bends, allowMissingColumns=True)
    here = hits.select(F.col("track").alias("_t"), F.col("n").alias("_n"), F.col("cls").alias("at_cls"))
    starts = starts.join(here, _same("n")).drop("_t", "_n")
    spans = written(_spans(starts, hits).withColumn("trail", F.col("road") == "trail").withColumn("metres", F.col("until") - F.col("along")))
    ends = hits.groupBy(F.col("track").alias("_t")).agg(F.max("along").alias("whole"), F.min(F.struct("n", "time"))["time"].alias("t0"), F.max(F.struct("n", "time"))["time"].alias("t1"))
    shares = spans.groupBy(F.col("track").alias("_t")).agg(F.sum(F.when(F.col("trail"), F.col("metres")).otherwise(0.0)).alias("trail_m"))
    met = spans.join(ends, _same()).drop("_t").join(shares, _same()).drop("_t")
    recorded = F.coalesce(F.col("t1") > F.col("t0"), F.lit(False)) & F.coalesce(F.col("until_time") >= F.col("time"), F.lit(False))
    speeds = F.create_map(*[F.lit(x) for pair in TYPE_KMH.items() for x in (pair[0], float(pair[1]))])
    caps = F.create_map(*[F.lit(x) for pair in CLASS_CAP_KMH.items() for x in pair])
    kmh = F.least(F.coalesce(F.try_element_at(speeds, F.coalesce("type", F.lit(0))), F.lit(OTHER_KMH)), F.coalesce(F.try_element_at(caps, F.coalesce("at_cls", F.lit(0))), F.lit(math.inf)))
    seconds = F.when(recorded, (F.col("until_time") - F.col("time")) / 1000).when(F.col("trail") | (F.col("trail_m") > F.col("whole") * MOSTLY_TRAIL), F.col("metres") / WALK_MPS).otherwise(F.col("metres") / (kmh / 3.6))
    first = F.row_number().over(in_order()) == 1
    return met.select("track", "n", "name", F.coalesce("type", F.lit(0)).alias("type"), (~first).alias("junction"), "trail", "bend", (F.coalesce("cls", F.lit(0)) > 0).alias("highland"), "metres", seconds.alias("seconds"))
