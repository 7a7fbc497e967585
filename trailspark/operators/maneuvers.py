"""Instructions along a way: setting off, turns, changes of road, roundabouts, waypoints, arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geo, text
from trailspark.operators.matching import along, between_ways, in_order, turns, way

# The line type of roundabouts, words of directions and turns, degrees from which a turn has its kind, metres within which of
# two turns the second counts, degrees of a bend that the same road has without an instruction, metres of the first direction.
ROUNDABOUT = 0x0C
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
TURN_WORDS = {"straight": "Go straight", "slight-left": "Keep left", "slight-right": "Keep right", "left": "Turn left", "right": "Turn right", "sharp-left": "Turn sharp left", "sharp-right": "Turn sharp right", "uturn": "Make a U-turn"}
KINDS = ((20, ""), (45, "slight-"), (135, ""), (170, "sharp-"))
CLOSE_M = 20.0
SAME_ROAD_DEG = 60.0
SETTING_OFF_M = 50

OPTIONAL = {"via": "int", "join": "string", "off_road": "boolean", "bend": "boolean", "trail": "boolean"}


def classified(angle: Column) -> Column:
    """The name of a turn by its angle, right positive."""
    side, size = F.when(angle > 0, "right").otherwise("left"), F.abs(angle)
    return F.when(size < KINDS[0][0], "straight").when(size < KINDS[1][0], F.concat(F.lit("slight-"), side)).when(size < KINDS[2][0], side).when(size < KINDS[3][0], F.concat(F.lit("sharp-"), side)).otherwise("uturn")


def ordinal(n: Column) -> Column:
    end = F.when((n % 10 == 1) & (n % 100 != 11), "st").when((n % 10 == 2) & (n % 100 != 12), "nd").when((n % 10 == 3) & (n % 100 != 13), "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def _setting_off(points: DataFrame) -> DataFrame:
    """track and the compass direction over the first 50 m; of a shorter way, to its last point."""
    spot = F.struct("n", "along", "lon", "lat")
    marked = points.withColumn("_p", spot).withColumn("_prev", F.lag(spot).over(in_order()))
    found = marked.groupBy("track").agg(F.min("_p").alias("a"), F.max("_p").alias("z"), F.min(F.when(F.col("along") >= SETTING_OFF_M, F.struct("_p", "_prev"))).alias("far"))
    near, far = F.coalesce(F.col("far._prev"), F.col("far._p")), F.col("far._p")
    t = F.when(far["along"] == near["along"], 0.0).otherwise((SETTING_OFF_M - near["along"]) / (far["along"] - near["along"]))
    to = lambda c: F.when(F.col("far").isNull(), F.col("z")[c]).otherwise(near[c] + (far[c] - near[c]) * t)
    heading = way(F.col("a.lon"), F.col("a.lat"), to("lon"), to("lat"))
    return found.select(F.col("track").alias("_t"), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), (geo.js_round(heading / 45) % 8 + 1).cast("int")).alias("heading"))


def instructions(points: DataFrame, stretches: DataFrame, destinations: DataFrame) -> DataFrame:
    """track, step (from 0), n (the point), along, kind, turn, exit, exit_angle, via, road and text, in the order of the way.

    points: track, n, lon, lat. stretches: track, n (its first point, the first of all at the way's), name, type, junction, and if there
    trail (off the roads), bend (of a trail), off_road (a straight leg), via (a waypoint's number), join (the track met). destinations:
    track, dest. Ways without a stretch or a destination give nothing. A null track is a way of its own.

    Going straight on the same road needs no instruction, nor a bend of less than 60 degrees of the same road; a change of road
    straight on continues; each stretch on a roundabout passes an exit, and the stretch that leaves it has no turn of its own. Of
    two turns less than 20 m apart the second counts.
    """
    w = in_order()
    for c, kind in OPTIONAL.items():
        if c not in stretches.columns:
            stretches = stretches.withColumn(c, F.lit(None).cast(kind))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = F.when(flag("off_road"), F.lit(None).cast("string")).when(flag("trail"), "the trail").otherwise(text.road_label(F.col("name")))
    line = turns(along(points.select("track", "n", "lon", "lat")))
    ends = line.groupBy(F.col("track").alias("_t")).agg(F.max(F.struct("n", "along", "way_out")).alias("last"))
    at = line.select(F.col("track").alias("_t"), F.col("n").alias("_n"), "along", "way_in", "way_out", F.col("turn").alias("angle"))
    same = lambda n=None: F.col("track").eqNullSafe(F.col("_t")) if n is None else F.col("track").eqNullSafe(F.col("_t")) & (F.col(n) == F.col("_n"))
    segs = stretches.join(at, same("n")).drop("_t", "_n").withColumn("label", label).withColumn("round", F.coalesce(F.col("type") == ROUNDABOUT, F.lit(False)))
    before = Window.partitionBy("track").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("track").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    plain = F.col("via").isNull() & F.col("join").isNull() & ~flag("bend")
    segs = segs.withColumn("i", F.row_number().over(w) - 1).withColumn("was_round", F.coalesce(F.lag("round").over(w), F.lit(False)))
    segs = segs.withColumn("enters", F.col("round") & ~F.col("was_round") & (F.col("i") > 0) & plain)
    segs = segs.withColumn("told", F.last(F.when(F.col("round") & ~F.col("was_round"), F.col("enters")), ignorenulls=True).over(before))
    segs = segs.withColumn("leaves", ~F.col("round") & F.col("was_round") & F.coalesce("told", F.lit(False)))
    segs = segs.withColumn("off", F.last(F.when(~F.col("round"), F.struct("i", "label", "way_out")), ignorenulls=True).over(after))
    segs = segs.withColumn("label_before", F.lag("label").over(w)).withColumn("size", F.count("*").over(Window.partitionBy("track")))
    segs = segs.join(ends, same()).drop("_t").join(destinations.select(F.col("track").alias("_t"), "dest"), same()).drop("_t").join(_setting_off(line), same()).drop("_t")

    changed = ~F.col("label").eqNullSafe(F.col("label_before"))
    turn, size = classified(F.col("angle")), F.abs("angle")
    words = F.element_at(F.create_map(*[F.lit(x) for pair in TURN_WORDS.items() for x in pair]), turn)
    onto = lambda road: F.coalesce(F.concat(F.lit(" onto "), road), F.lit(""))
    turned = F.when(turn.startswith("slight"), "keep").otherwise("turn")
    exits = F.coalesce(F.col("off.i"), F.col("size")) - F.col("i")
    exit_angle = geo.js_round(between_ways(F.col("way_in"), F.coalesce(F.col("off.way_out"), F.col("last.way_out"))))

    def made(kind, said, road=F.col("label"), **more) -> Column:
        as_column = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
        return F.struct(as_column(kind, "string").alias("kind"), as_column(more.get("turn"), "string").alias("turn"), as_column(more.get("exit"), "int").alias("exit"), as_column(more.get("exit_angle"), "long").alias("exit_angle"), as_column(more.get("via"), "int").alias("via"), road.cast("string").alias("road"), said.alias("text"))

    waypoint = made("via", F.concat(F.lit("Waypoint "), F.col("via").cast("string")), via=F.col("via"))
    road = F.col("label")
    stay = F.concat(words, F.lit(" to stay on "), F.coalesce(road, F.lit("this road")))
    told = (
        F.when(F.col("leaves"), F.when(F.col("via") > 0, waypoint))
        .when(F.col("via") > 0, waypoint)
        .when(F.col("join").isNotNull(), made("join", F.concat(F.lit("Join "), F.col("join"))))
        .when(flag("bend"), F.when(turn != "straight", made(turned, F.concat(words, F.lit(" on the trail")), F.lit("the trail"), turn=turn)))
        .when(F.col("enters"), made("roundabout", F.concat(F.lit("At the roundabout, take the "), ordinal(exits), F.lit(" exit"), onto(F.col("off.label"))), F.col("off.label"), exit=exits, exit_angle=exit_angle))
        .when(F.col("round"), None)
        .when(~flag("junction") & ~changed, None)
        .when(turn == "straight", F.when(changed & road.isNotNull(), made("continue", F.concat(F.lit("Continue onto "), road), turn=turn)))
        .when(~changed & (size < SAME_ROAD_DEG), None)
        .otherwise(made(turned, F.when(changed, F.concat(words, onto(road))).otherwise(stay), turn=turn))
    )
    start = made("depart", F.concat(F.lit("Head "), F.col("heading"), F.coalesce(F.concat(F.lit(" on "), road), F.lit(""))))
    end = made("arrive", F.concat(F.lit("Arrive at "), F.col("dest")), F.lit(None))
    on_way = segs.select("track", "i", "n", "along", F.when(F.col("i") == 0, start).otherwise(told).alias("m")).where("m is not null")
    arriving = segs.where("i = 0").select("track", F.col("size").alias("i"), F.col("last.n").alias("n"), F.col("last.along").alias("along"), end.alias("m"))
    out = on_way.unionByName(arriving).select("track", "i", "n", "along", "m.*")
    order = Window.partitionBy("track").orderBy("i")
    turnish = F.col("kind").isin("turn", "keep", "continue")
    close = turnish & F.coalesce(F.lead(turnish).over(order), F.lit(False)) & (F.lead("along").over(order) - F.col("along") < CLOSE_M)
    kept = out.withColumn("_close", F.coalesce(close, F.lit(False))).where("not _close").drop("_close")
    return kept.withColumn("step", F.row_number().over(order) - 1).select("track", "step", "n", "along", "kind", "turn", "exit", "exit_angle", "via", "road", "text")
