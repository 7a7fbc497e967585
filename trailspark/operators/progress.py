"""Where a position along a way lies on it, what is left of the way, the stretch it is on and the instruction that comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators import spatial
from trailspark.operators.matching import in_order


def timed(points: DataFrame, stretches: DataFrame) -> DataFrame:
    """points (track, n, along, ...) with ``seconds`` from the way's start.

    stretches: track, n (its first point), seconds. A stretch's seconds are spread over its points by distance; a stretch
    without length takes none. Points before the first stretch are at 0.
    """
    at = points.select(F.col("track").alias("_t"), F.col("n").alias("_n"), F.col("along").alias("_from"))
    ends = points.groupBy(F.col("track").alias("_e")).agg(F.max("along").alias("_whole"))
    same = F.col("track").eqNullSafe(F.col("_t")) & (F.col("n") == F.col("_n"))
    spans = stretches.select("track", "n", F.col("seconds").alias("_s")).join(at, same).drop("_t", "_n").join(ends, F.col("track").eqNullSafe(F.col("_e"))).drop("_e")
    spans = spans.withColumn("_until", F.coalesce(F.lead("_from").over(in_order()), F.col("_whole")))
    took = F.when(F.col("_until") > F.col("_from"), F.col("_s")).otherwise(0.0)
    before = F.coalesce(F.sum(took).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spans = spans.select("track", "n", "_from", "_until", took.alias("_took"), before.alias("_before"))
    met = spatial.asof(points, spans, ["track"], "n", ["_from", "_until", "_took", "_before"])
    share = F.when(F.col("_until") > F.col("_from"), (F.col("along") - F.col("_from")) / (F.col("_until") - F.col("_from"))).otherwise(0.0)
    return met.withColumn("seconds", F.coalesce(F.col("_before") + F.col("_took") * share, F.lit(0.0))).drop("_from", "_until", "_took", "_before")


def located(positions: DataFrame, points: DataFrame) -> DataFrame:
    """positions (track, along, ...) with n (the point before), lon and lat there, and metres and seconds left.

    points: track, n, along, lon, lat, seconds (as of ``timed``). Between points all goes by distance. Before the start the way is
    continued backwards for the seconds alone; beyond the end nothing is left and the end is the place. A position on a way without
    points has nulls. Each is met by one as-of join, not by the way's points.
    """
    spot = ["along", "lon", "lat", "seconds"]
    w = in_order()
    ends = points.groupBy(F.col("track").alias("_e")).agg(F.max(F.struct("n", *spot)).alias("_end"), F.min(F.struct("n", *spot)).alias("_start"))
    legs = points.select("track", F.col("along").alias("at"), "n", *[F.col(c).alias(f"a_{c}") for c in spot], *[F.lead(c).over(w).alias(f"b_{c}") for c in spot])
    # of points at one place the last counts
    found = spatial.asof(positions.withColumn("at", F.col("along")), legs, ["track"], "at", ["n", *[f"{s}_{c}" for s in "ab" for c in spot]]).drop("at")
    found = found.join(ends, F.col("track").eqNullSafe(F.col("_e")), "left").drop("_e")
    share = F.when(F.col("b_along") > F.col("a_along"), (F.col("along") - F.col("a_along")) / (F.col("b_along") - F.col("a_along"))).otherwise(0.0)
    early, late = F.col("n").isNull(), F.col("b_along").isNull()
    place = lambda c: F.when(early, F.col("_start")[c]).when(late, F.col("_end")[c]).otherwise(F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * share)
    left_m = F.greatest(F.col("_end.along") - F.col("along"), F.lit(0.0))
    left_s = F.greatest(F.col("_end.seconds") - place("seconds"), F.lit(0.0))
    known = F.col("_end").isNotNull()
    return found.select(*positions.columns, F.coalesce("n", F.col("_start.n")).alias("n"), place("lon").alias("lon"), place("lat").alias("lat"), F.when(known, left_m).alias("metres_left"), F.when(known, left_s).alias("seconds_left"))


def guided(positions: DataFrame, stretches: DataFrame, told: DataFrame) -> DataFrame:
    """positions (track, along, n, ...) with the name of the stretch they are on, and the next instruction and the metres to it.

    stretches: track, n, name, trail. told: track, along, step, text. An instruction at the position itself is past; behind the last there
    is none.
    """
    on = spatial.asof(positions, stretches.select("track", "n", "name", "trail"), ["track"], "n", ["name", "trail"])
    nexts = told.select("track", (-F.col("along")).alias("_minus"), F.col("along").alias("next_along"), "step", "text")
    # ahead is behind when distances are turned round; of instructions at one place the first counts
    order = ["next_along", "_back", "text"]
    met = spatial.asof(on.withColumn("_minus", -F.col("along")), nexts.withColumn("_back", -F.col("step")), ["track"], "_minus", order, strict=True)
    return met.withColumn("to_next", F.col("next_along") - F.col("along")).withColumnRenamed("text", "next").drop("_minus", "_back", "next_along")
