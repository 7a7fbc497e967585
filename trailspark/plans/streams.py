"""Folds over tracks as streams; their rows equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.plans import adapters as A
from trailspark.plans import tracks
from trailspark.streaming import folds


def stream_off_route(spark: SparkSession, d: str) -> DataFrame:
    """How often each track went off its route, counted by a stream in two runs."""
    f = A.fixes(spark, d).select("track", "n", "ts", (F.col("i") * 7 % 110).cast("double").alias("off"), "accuracy")
    return folds.replay(f, "ts", folds.off_route).groupBy("track").agg(F.max_by("times", "upto").alias("times"))


def stream_speed(spark: SparkSession, d: str) -> DataFrame:
    """Each track's smoothed value at its end, by a stream in two runs."""
    f = A.fixes(spark, d).select("track", "n", "ts", "ele")
    return folds.replay(f, "ts", folds.speed).groupBy("track").agg(F.round(F.max_by("speed", "upto"), 6).alias("speed"))


def stream_thinner(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes a recorder keeps of each track and the last of them, by a stream in two runs."""
    f = A.fixes(spark, d).select("track", "n", "ts", "lon", "lat")
    return folds.replay(f, "ts", folds.thinned).groupBy("track").agg(F.count("*").alias("kept"), F.max("at").alias("last"))


QUERIES = {f.__name__: f for f in (stream_off_route, stream_speed, stream_thinner)}

ORACLES = {"stream_off_route": tracks.ORACLES["off_route_debounce"], "stream_speed": tracks.ORACLES["ema_speed"], "stream_thinner": tracks.ORACLES["thin_track"]}
