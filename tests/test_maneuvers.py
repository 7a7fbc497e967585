"""Instructions on small ways, each rule once."""

import pytest

from trailspark.operators import maneuvers

SEG = "track long, n int, name string, type int, junction boolean, trail boolean, bend boolean, off_road boolean, via int, join string"
R = maneuvers.ROUNDABOUT
CORNER = [(0, 0), (0, 0.002), (-0.002, 0.002)]
RIGHT = [(0, 0), (0, 0.002), (0.002, 0.002)]
ROW = [(0, 0), (0, 0.002), (0, 0.004), (0, 0.006)]
RING = [(0, 0), (0, 0.002), (0.0003, 0.0023), (0.0006, 0.002), (0.0006, 0)]


def seg(n, name, type_=1, junction=True, **more):
    return (n, name, type_, junction, *[more.get(c) for c in ("trail", "bend", "off_road", "via", "join")])


CASES = {
    "a turn": (CORNER, [seg(0, "1"), seg(1, "26")], ["depart: Head north on road 1", "turn: Turn left onto road 26", "arrive: Arrive at X"]),
    "straight on": (ROW, [seg(0, "1"), seg(1, "1"), seg(2, "35")], ["depart: Head north on road 1", "continue: Continue onto road 35", "arrive: Arrive at X"]),
    "straight on to a road without a name": (ROW, [seg(0, "1"), seg(1, None)], ["depart: Head north on road 1", "arrive: Arrive at X"]),
    "second exit": (RING, [seg(0, "1"), seg(1, None, R), seg(2, None, R, False), seg(3, "1", junction=False)], ["depart: Head north on road 1", "roundabout: At the roundabout, take the 2nd exit onto road 1", "arrive: Arrive at X"]),
    "a way that ends on a roundabout": (RING, [seg(0, "1"), seg(1, None, R), seg(2, None, R), seg(3, None, R)], ["depart: Head north on road 1", "roundabout: At the roundabout, take the 3rd exit", "arrive: Arrive at X"]),
    "a way that begins on one": (RING, [seg(0, None, R), seg(1, None, R), seg(3, "2")], ["depart: Head north", "keep: Keep right onto road 2", "arrive: Arrive at X"]),
    "a slight bend of the same road": ([(0, 0), (0, 0.002), (0.001, 0.004)], [seg(0, "1"), seg(1, "1")], ["depart: Head north on road 1", "arrive: Arrive at X"]),
    "a corner of the same road": (RIGHT, [seg(0, "1"), seg(1, "1")], ["depart: Head north on road 1", "turn: Turn right to stay on road 1", "arrive: Arrive at X"]),
    "a corner without a name": (RIGHT, [seg(0, None), seg(1, None)], ["depart: Head north", "turn: Turn right to stay on this road", "arrive: Arrive at X"]),
    "no junction, another road": (CORNER, [seg(0, "GRÆNAGATA"), seg(1, "STÓRA-BRAUT", junction=False)], ["depart: Head north on Grænagata", "turn: Turn left onto Stóra-Braut", "arrive: Arrive at X"]),
    "no junction, the same road": (CORNER, [seg(0, "1"), seg(1, "1", junction=False)], ["depart: Head north on road 1", "arrive: Arrive at X"]),
    "a waypoint before a turn": ([(0, 0), (0, 0.002), (0, 0.0021), (-0.002, 0.0021)], [seg(0, "1"), seg(1, "1", via=1), seg(2, "26")], ["depart: Head north on road 1", "via: Waypoint 1", "turn: Turn left onto road 26", "arrive: Arrive at X"]),
    "a waypoint behind a roundabout": (RING, [seg(0, "1"), seg(1, None, R), seg(2, None, R), seg(3, "1", via=1)], ["depart: Head north on road 1", "roundabout: At the roundabout, take the 2nd exit onto road 1", "via: Waypoint 1", "arrive: Arrive at X"]),
    "a waypoint on a roundabout's first stretch": (RING, [seg(0, "1"), seg(1, None, R, via=2), seg(2, None, R), seg(3, "1", junction=False)], ["depart: Head north on road 1", "via: Waypoint 2", "keep: Keep right onto road 1", "arrive: Arrive at X"]),
    "two turns near each other": ([(0, 0), (0, 0.002), (-0.0001, 0.002), (-0.0001, 0.004)], [seg(0, "1"), seg(1, "2"), seg(2, "3")], ["depart: Head north on road 1", "keep: Keep right onto road 3", "arrive: Arrive at X"]),
    "a trail and its bend": (RIGHT + [(0.002, 0.004)], [seg(0, "F 26"), seg(1, None, 0, trail=True), seg(2, None, 0, trail=True, bend=True)], ["depart: Head north on F26", "turn: Turn right onto the trail", "turn: Turn left on the trail", "arrive: Arrive at X"]),
    "a bend that is none": (ROW, [seg(0, None, 0, trail=True), seg(1, None, 0, trail=True, bend=True)], ["depart: Head north on the trail", "arrive: Arrive at X"]),
    "off the road, then a track": (CORNER, [seg(0, None, 0, trail=True, off_road=True), seg(1, None, 0, trail=True, join="Old way")], ["depart: Head north", "join: Join Old way", "arrive: Arrive at X"]),
}


def told(spark, ways, stretches):
    points = [(k, i, *map(float, p)) for k, way in enumerate(ways) for i, p in enumerate(way)]
    segs = [(k, *s) for k, own in enumerate(stretches) for s in own]
    dests = spark.createDataFrame([(k, "X") for k in range(len(ways))], "track long, dest string")
    return maneuvers.instructions(spark.createDataFrame(points, "track long, n int, lon double, lat double"), spark.createDataFrame(segs, SEG), dests).orderBy("track", "step").collect()


def test_rules(spark):
    out = {name: [] for name in CASES}
    for r in told(spark, [c[0] for c in CASES.values()], [c[1] for c in CASES.values()]):
        own = out[list(CASES)[r["track"]]]
        assert r["step"] == len(own)
        own.append(f"{r['kind']}: {r['text']}")
    assert out == {name: c[2] for name, c in CASES.items()}


def test_exits_point_relative_to_the_way_in(spark):
    ways = [[(0, 0), (0, 0.002), (0.0002, 0.0022), (0.0002 + x, 0.0022 + y)] for x, y in ((0.002, 0), (0, 0.002), (-0.002, 0))]
    got = told(spark, ways, [[seg(0, "1"), seg(1, None, R), seg(2, "35", junction=False)]] * 3)
    assert [(r["exit"], r["exit_angle"]) for r in got if r["kind"] == "roundabout"] == [(1, 90), (1, 0), (1, -90)]


def test_places_along_the_way(spark):
    got = told(spark, [ROW], [[seg(0, "1"), seg(1, "1", via=1)]])
    assert [(r["n"], r["via"], round(r["along"])) for r in got] == [(0, None, 0), (1, 1, 222), (3, None, 667)]
    assert got[0]["along"] == pytest.approx(0)
    assert told(spark, [ROW], [[]]) == []
