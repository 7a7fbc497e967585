"""Files of movement, written from the test tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.plans import adapters as A
from trailspark.sources import movement
from trailspark.tables import shared_folder


def gpx_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Points of all users' tracks after a trip through GPX; a track of one point is no line."""
    back = movement.gpx_round_trip(A.fixes(spark, d), "track", "n")
    return back.select("name", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def trip_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Points of all users' tracks after they were written as addresses, a line each, and read again, by the trips' ids."""
    points = A.fixes(spark, d).select("track", "n", F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), "lat", "lon")
    path = shared_folder(spark)
    movement.trip_fragments(points, "track", "n").select(F.concat_ws("\t", F.col("track").cast("string"), F.concat(F.lit("#"), "fragment")).alias("line")).write.text(path)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).select(F.col("f")[0].cast("long").alias("track"), F.col("f")[1].alias("fragment"))
    back = movement.trip_points(lines, "track")
    return back.select("track", movement.trip_id(F.col("start")).alias("trip"), "end", "n", "lat", "lon", "time")


QUERIES = {"gpx_tracks": gpx_tracks, "trip_fragments": trip_fragments}

ORACLES = {"gpx_tracks": f"with {A.FIXES} select track::varchar as name, (n - 1)::int as n, round(lon, 6) as lon, round(lat, 6) as lat from fixes qualify count(*) over (partition by track) >= 2"}
ORACLES["trip_fragments"] = f"""with {A.FIXES}, m as (select *, epoch_us(ts) // 1000 as ms, min(epoch_us(ts) // 1000) over (partition by track) as start, max(epoch_us(ts) // 1000) over (partition by track) as stop from fixes)
select track, 'trip-' || lower(to_base(start, 36)) as trip, stop as end, (n - 1)::int as n, floor(lat * 1e5 + 0.5) / 1e5 as lat, floor(lon * 1e5 + 0.5) / 1e5 as lon, (ms // 1000) * 1000 as time from m"""
