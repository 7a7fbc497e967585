"""Places, what is left and what comes next along small ways."""

import pytest

from trailspark.operators import matching, progress


def ways(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.002), (1, 2, 0.0, 0.002), (1, 3, -0.002, 0.002), (None, 0, 5.0, 5.0)]
    points = matching.along(spark.createDataFrame(rows, "track int, n int, lon double, lat double"))
    stretches = spark.createDataFrame([(1, 0, 20.0, "1", False), (1, 1, 7.0, "none", False), (1, 2, 60.0, "26", False), (None, 0, 9.0, "spot", True)], "track int, n int, seconds double, name string, trail boolean")
    return points, stretches


def test_times_of_points(spark):
    got = {(r["track"], r["n"]): r["seconds"] for r in progress.timed(*ways(spark)).collect()}
    assert got == pytest.approx({(1, 0): 0.0, (1, 1): 20.0, (1, 2): 20.0, (1, 3): 80.0, (None, 0): 0.0})  # a stretch without length takes none


def test_places_and_what_is_left(spark):
    points, stretches = ways(spark)
    line = progress.timed(points, stretches)
    total = points.where("track = 1").agg({"along": "max"}).first()[0]
    asked = spark.createDataFrame([(1, "half", 111.1949), (1, "start", 0.0), (1, "before", -50.0), (1, "corner", total / 2), (1, "end", total), (1, "beyond", 1e9), (None, "spot", 3.0), (7, "nowhere", 1.0)], "track int, id string, along double")
    got = {r["id"]: r for r in progress.located(asked, line).collect()}
    assert (got["half"]["lat"], got["half"]["metres_left"], got["half"]["seconds_left"]) == (pytest.approx(0.001), pytest.approx(333.6, abs=0.1), pytest.approx(70.0))
    assert (got["start"]["n"], got["start"]["seconds_left"]) == (0, pytest.approx(80.0))
    assert (got["before"]["lat"], got["before"]["metres_left"], got["before"]["seconds_left"]) == (0.0, pytest.approx(total + 50), pytest.approx(80.0))
    assert (got["corner"]["n"], got["corner"]["seconds_left"]) in ((2, pytest.approx(60.0)), (0, pytest.approx(60.0)))
    for k in ("end", "beyond"):
        assert (got[k]["lon"], got[k]["metres_left"], got[k]["seconds_left"]) == (-0.002, pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))
    assert (got["spot"]["lon"], got["spot"]["metres_left"]) == (5.0, 0.0)
    assert got["nowhere"]["lon"] is None and got["nowhere"]["metres_left"] is None


def test_the_next_instruction(spark):
    _, stretches = ways(spark)
    told = spark.createDataFrame([(1, 0, 0.0, "go"), (1, 1, 100.0, "first"), (1, 2, 100.0, "second"), (1, 3, 200.0, "end")], "track int, step int, along double, text string")
    asked = spark.createDataFrame([(1, 0, 0.0), (1, 0, 99.0), (1, 2, 100.0), (1, 3, 200.0), (2, 0, 5.0)], "track int, n int, along double")
    got = [(r["track"], r["along"], r["name"], r["next"], r["to_next"]) for r in progress.guided(asked, stretches, told).orderBy("track", "along").collect()]
    assert got == [(1, 0.0, "1", "first", 100.0), (1, 99.0, "1", "first", 1.0), (1, 100.0, "26", "end", 100.0), (1, 200.0, "26", None, None), (2, 5.0, None, None, None)]
