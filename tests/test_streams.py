"""Streams equal the batch forms, whatever is missing."""

from pyspark.sql import functions as F

from trailspark.plans import registry
from trailspark.streaming import folds

TABLES = "/root/testdata/sf0.001"


def test_thinner_equals_batch(spark):
    got, want = (sorted(map(tuple, registry.QUERIES[q](spark, TABLES).select("track", "kept", "last").collect())) for q in ("stream_thinner", "thin_track"))
    assert got and got == want


def test_state_goes_on_over_runs_and_unknown_values(spark):
    rows = [("a", n, n, off, acc) for n, (off, acc) in enumerate([(60.0, 5), (60.0, 90), (None, 5), (60.0, 5), (60.0, 5), (30.0, 5), (10.0, 5), (60.0, None)])] + [(None, 0, None, 60.0, 5)]
    f = spark.createDataFrame(rows, "track string, n int, ts int, off double, accuracy int")
    got = folds.replay(f, "ts", folds.off_route)
    assert got.count() == 3  # two runs of a, one of the unknown track
    last = {r["track"]: (r["off"], r["times"]) for r in got.groupBy("track").agg(F.max_by("off", "upto").alias("off"), F.max("times").alias("times")).collect()}
    assert last == {"a": (False, 1), None: (False, 0)}
    assert folds.replay(f.where("false"), "ts", folds.off_route).count() == 0


def test_speed_is_null_until_known(spark):
    f = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, 10.0), ("a", 3, 3, None), ("a", 4, 4, 20.0), ("b", 1, 1, None)], "track string, n int, ts int, ele double")
    got = folds.replay(f, "ts", folds.speed).groupBy("track").agg(F.max_by("speed", "upto").alias("speed"))
    assert {r["track"]: r["speed"] for r in got.collect()} == {"a": 14.0, "b": None}
