"""Readers of movement files on hand-made documents."""

from datetime import datetime

from trailspark.sources import movement

GPX = """<?xml version="1.0"?>
<!-- a comment -->
<gpx version="1.1" xmlns:g="http://www.topografix.com/GPX/1/1">
 <metadata><name>Day out</name></metadata>
 <wpt lat="64.1" lon="-21.9"><name><![CDATA[Hut & spring]]></name></wpt>
 <wpt lat="95" lon="0"><name>off the globe</name></wpt>
 <rte><name>Plan</name><rtept lat="64.0" lon="-20.0"/><rtept lat="64.5" lon="-20.5"/></rte>
 <g:trk>
  <g:trkseg><g:trkpt lat="64.0" lon="-20.0"><g:ele>12.5</g:ele><g:time>2026-01-02T03:04:05Z</g:time></g:trkpt><g:trkpt lat="x" lon="1"/><g:trkpt lat="64.1" lon="-20.1"><g:ele>high</g:ele></g:trkpt></g:trkseg>
  <g:trkseg><g:trkpt lat="64.2" lon="-20.2"/></g:trkseg>
  <g:name>Walk</g:name>
 </g:trk>
</gpx>"""


def test_gpx_reader(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.gpx").write_text("<html><body>none</body></html>")
    rows = sorted(tuple(r) for r in movement.gpx_lines(spark, str(tmp_path)).drop("file", "time").collect())
    assert rows == [("Day out", "route", 0, 0, "Plan", 0, 64.0, -20.0, None), ("Day out", "route", 0, 0, "Plan", 1, 64.5, -20.5, None), ("Day out", "track", 0, 0, "Walk", 0, 64.0, -20.0, 12.5), ("Day out", "track", 0, 0, "Walk", 1, 64.1, -20.1, None)]
    times = [r["time"] for r in movement.gpx_lines(spark, str(tmp_path)).where("kind = 'track' and n = 0").selectExpr("date_format(time, 'yyyy-MM-dd HH:mm:ss') as time").collect()]
    assert times == ["2026-01-02 03:04:05"]
    assert [(r["n"], r["name"], r["lat"]) for r in movement.gpx_waypoints(spark, str(tmp_path)).collect()] == [(0, "Hut & spring", 64.1)]


def test_gpx_writer_keeps_order_heights_times_and_signs(spark, tmp_path):
    rows = [("a <&> b", 2, 64.5, -21.25, None, None), ("a <&> b", 1, 64.123456, -21.0, 7.26, datetime(2026, 1, 2, 3, 4, 5)), ("one", 1, 1.0, 1.0, 1.0, None)]
    points = spark.createDataFrame(rows, "name string, n int, lat double, lon double, ele double, time timestamp")
    movement.write_gpx(points, str(tmp_path / "out"), "name", "n")
    back = movement.gpx_lines(spark, str(tmp_path / "out")).orderBy("n").selectExpr("name", "n", "lat", "lon", "ele", "time is null as untimed").collect()
    assert [tuple(r) for r in back] == [("a <&> b", 0, 64.123456, -21.0, 7.3, False), ("a <&> b", 1, 64.5, -21.25, None, True)]
    assert movement.gpx_lines(spark, str(tmp_path / "out")).where("n = 0").select("time").first()["time"] == datetime(2026, 1, 2, 3, 4, 5)


def test_trip_lines_skip_what_is_no_fix(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1000,64.1,-20.5\nbad\n2000,91,0\n,64,0\n3000, 64.2 ,-20.6\n4000,64.2,-20.6,9\n5000,NaN,0\n")
    assert sorted((r["time"], r["lat"], r["lon"]) for r in movement.trip_lines(spark, str(tmp_path)).collect()) == [(1000, 64.1, -20.5), (3000, 64.2, -20.6)]


def encoded(v):
    """A number in the encoded-polyline form, bit by bit."""
    s, out = (v << 1) ^ (v >> 63), ""
    while s >= 32:
        out += chr((32 | s & 31) + 63)
        s >>= 5
    return out + chr(s + 63)


def test_trips_in_addresses(spark):
    from urllib.parse import quote

    points = [(64.12345, -21.98765, 1_700_000_001_999), (64.12346, -21.98765, 1_700_000_002_000), (-33.0, 179.99999, 1_700_000_000_500), (0.0, 0.0, 1_700_000_090_000)]
    df = spark.createDataFrame([("a", k, *p) for k, p in enumerate(points)] + [("b", 0, 1.0, 2.0, 5000), ("c", 0, None, 2.0, 5000)], "trip string, n int, lat double, lon double, time long")
    got = {r["trip"]: r["fragment"] for r in movement.trip_fragments(df, "trip", "n").collect()}
    coords, secs, before = "", "", (0, 0, 1_700_000_000)
    for lat, lon, t in points:
        now = (round(lat * 1e5), round(lon * 1e5), t // 1000)
        coords, secs, before = coords + encoded(now[0] - before[0]) + encoded(now[1] - before[1]), secs + encoded(now[2] - before[2]), now
    assert got["a"] == "trip=1.1700000000500.1700000090000." + quote(coords, safe="?@_~") + "." + quote(secs, safe="?@_~") and set(got) == {"a", "b"}

    a = got["a"]
    others = {"hash": "#" + a, "cut": a[:-2] + ".", "bad": a.replace("trip=1", "trip=2"), "broken": a + "%", "odd": "trip=1.5.6.????.?", "none": "trip=1.5.6..", "space": "trip=1.5.6.?+.?", "open": "trip=1.5.6.??._", None: a}
    lines = spark.createDataFrame([(k, v) for k, v in others.items()], "k string, fragment string").where("k is not null")
    back = movement.trip_points(lines, "k").orderBy("k", "n").collect()
    assert [(r["k"], r["n"], r["lat"], r["lon"], r["time"]) for r in back] == [("hash", k, lat, lon, t // 1000 * 1000) for k, (lat, lon, t) in enumerate(points)]
    assert {(r["start"], r["end"]) for r in back} == {(1_700_000_000_500, 1_700_000_090_000)}
    ids = spark.createDataFrame([(1_700_000_000_500,), (35,)], "t long")
    assert [r[0] for r in ids.select(movement.trip_id(ids["t"])).collect()] == ["trip-loyw3vg4", "trip-z"]
