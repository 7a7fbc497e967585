"""Nearest places on the sphere against all pairs, and what pins are named after."""

import math
import random

import pytest

from trailspark.operators import spatial
from trailspark.plans import places


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("depth", [3, 9])
def test_nearest_equals_all_pairs(spark, depth):
    rng = random.Random(depth)
    targets = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(60)]
    targets += [(100 + i, rng.uniform(20, 20.2), rng.uniform(50, 50.1)) for i in range(40)] + [(200, -179.95, 65.0), (201, 10.0, 90.0), (202, 20.1, 50.05), (203, 20.1, 50.05)]
    points = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(120)]
    points += [(500 + i, rng.uniform(19.9, 20.3), rng.uniform(49.9, 50.2)) for i in range(60)] + [(600, 179.95, 65.0), (601, -120.0, 89.9), (602, 20.1, 50.05), (603, 180.0, 0.0), (604, 0.0, -90.0)]
    p = spark.createDataFrame([(*r, "x") for r in points] + [(999, None, 1.0, "x")], "id long, lon double, lat double, label string")
    t = spark.createDataFrame([(*r, "t") for r in targets] + [(998, 1.0, None, "t")], "t_id long, t_lon double, t_lat double, town string")
    want = {i: min((km((x, y), (a, b)), k) for k, a, b in targets) for i, x, y in points}
    for most in (None, 400.0):
        got = {r["id"]: (r["t_id"], r["km"]) for r in spatial.nearest(p, t, "id", "t_id", most, depth).collect()}
        assert got == {i: (k, pytest.approx(d, rel=1e-9, abs=1e-9)) for i, (d, k) in want.items() if most is None or d <= most}
    assert got[600][0] == 200 and got[602][0] == 202


def test_no_targets(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lon double, lat double")
    t = spark.createDataFrame([], "t_id long, t_lon double, t_lat double")
    assert spatial.nearest(p, t, "id", "t_id").count() == 0 and spatial.nearest(p.limit(0), t, "id", "t_id").count() == 0


def test_pins_are_named_after_named_points(spark):
    deg = 1 / 111.195
    rows = [(1, "HVERFJALL 463 m", 0.0, 1.0), (2, "12.5 - 3", 0.0, 0.1), (3, "Lake", 0.0, 0.2), (4, "Old farm", 0.0, 20.0), (5, "Stone hut", 0.0, 20.0), (6, "Far", 0.0, 50.0)]
    named = spark.createDataFrame([(i, n, e * deg, north * deg, "polygon" if n == "Lake" else "point") for i, n, e, north in rows], "place_id long, name string, lon double, lat double, kind string")
    pins = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 20.5 * deg), (3, 0.0, 46.9 * deg), (4, 0.0, 47.1 * deg)], "pin long, lon double, lat double")
    assert sorted((r["pin"], r["near_id"], r["label"]) for r in places.near_name(pins, named, "pin").collect()) == [(1, 1, "Near Hverfjall"), (2, 5, "Near Stone hut"), (4, 6, "Near Far")]


def test_the_tree_is_as_deep_as_targets_are_dense(spark):
    rng = random.Random(4)
    targets = [(i, rng.uniform(20, 20.2), rng.uniform(50, 50.1)) for i in range(1500)]
    points = [(i, rng.uniform(19.9, 20.3), rng.uniform(49.9, 50.2)) for i in range(150)] + [(1000 + i, rng.uniform(-180, 180), rng.uniform(-80, 200)) for i in range(150)]
    p, t = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(targets, "t_id long, t_lon double, t_lat double")
    got = {r["id"]: (r["t_id"], r["km"]) for r in spatial.nearest(p, t, "id", "t_id").collect()}
    want = {i: min((km((x, y), (a, b)), k) for k, a, b in targets) for i, x, y in points}
    assert got == {i: (k, pytest.approx(d, rel=1e-9, abs=1e-9)) for i, (d, k) in want.items()}
    cells = [(c, [(math.floor(v * 2**19) + 2**19) for v in (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))]) for c, x, y in targets]
    placed = spark.createDataFrame([tuple(v) for _, v in cells], "_c_x long, _c_y long, _c_z long")
    assert spatial._depth(placed, ["_c_x", "_c_y", "_c_z"]) > 11


def test_boxes_of_one_cell_meet_in_several_tasks(spark):
    boxes = lambda s: spark.range(60).coalesce(1).selectExpr(f"id {s}_id", *[f"cast(id % 7 + {d} as double) / 10 {s}_{c}" for d, c in ((0, "west"), (0, "south"), (2, "east"), (2, "north"))])
    met = spatial.bbox_join(boxes("l"), boxes("r"), 1.0)
    assert sorted(map(tuple, met.select("l_id", "r_id").collect())) == [(a, b) for a in range(60) for b in range(60) if abs(a % 7 - b % 7) <= 2]
    assert met.columns == [f"{s}_{c}" for s in "lr" for c in ("id", "west", "south", "east", "north")]
    assert met.selectExpr("spark_partition_id()").distinct().count() > 1
