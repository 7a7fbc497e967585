"""Map matching against a plain walk along each track."""

import math
import random

import pytest

from trailspark.operators import matching

M = 1 / 111_195
LAT = 64.0
MLON = M / math.cos(math.radians(LAT))


def plane(a, b):
    return 6371000.0 * math.hypot(math.radians(b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), math.radians(b[1] - a[1]))


def off(p, line):
    best = math.inf
    for a, b in zip(line, line[1:]):
        k, w = math.cos(math.radians(p[1])), (b[0] - a[0] + 180) % 360 - 180
        dx, dy, px, py = w * k, b[1] - a[1], (p[0] - a[0]) * k, p[1] - a[1]
        t = max(0, min(1, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        best = min(best, 111195 * math.hypot(px - t * dx, py - t * dy))
    return best


def by_force(coords, times, roads):
    """Stretches of one track: n, name, type, trail, bend, highland, seconds."""
    n = len(coords)
    if n == 1:
        return [(0, None, 0, True, False, False, 0.0)]
    cum = [0.0]
    for a, b in zip(coords, coords[1:]):
        cum.append(cum[-1] + plane(a, b))
    trail = ("trail", None, 0, 0)
    hits = []
    for p in coords:
        near = min(((round(off(p, line), 3), k) for k, (line, *_) in enumerate(roads)), default=(99, 0))
        hits.append((f"{roads[near[1]][1] or ''}|{roads[near[1]][2]}", *roads[near[1]][1:]) if near[0] <= 20 else trail)
    for i in range(1, n - 1):
        if hits[i - 1][0] == hits[i + 1][0] != hits[i][0]:
            hits[i] = hits[i - 1]

    def spot(k, side):
        goal, i = cum[k] + side * 30, k
        while 0 <= i + side < n and (cum[i + side] < goal if side == 1 else cum[i + side] > goal):
            i += side
        j = i + side
        if not 0 <= j < n:
            return coords[i]
        t = (goal - cum[i]) / (cum[j] - cum[i]) if cum[j] != cum[i] else 0
        return tuple(a + (b - a) * t for a, b in zip(coords[i], coords[j]))

    def way(a, b):
        return math.degrees(math.atan2((b[0] - a[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), b[1] - a[1])) % 360

    turn = [abs((way(coords[k], spot(k, 1)) - way(spot(k, -1), coords[k]) + 540) % 360 - 180) for k in range(n)]
    starts = [i for i in range(n) if i == 0 or hits[i][0] != hits[i - 1][0]]
    ends = [*starts[1:], n - 1]
    kept = [s for k, (s, e) in enumerate(zip(starts, ends)) if k == 0 or cum[e] - cum[s] >= 30]
    runs = []
    for s in kept:
        if not runs or hits[s][0] != runs[-1][1][0]:
            runs.append([s, hits[s]])
    for a, b in zip(runs, runs[1:]):
        inside = [i for i in range(a[0] + 1, b[0] + 1) if cum[b[0]] - cum[i] <= 40] or [b[0]]
        b[0] = max(inside, key=lambda i: (turn[i], i))
    out = []
    for k, (s, hit) in enumerate(runs):
        end = runs[k + 1][0] if k + 1 < len(runs) else n - 1
        out.append([s, *hit[1:3], hit[0] == "trail", False, hit[3] > 0])
        last = cum[s]
        for i in range(s + 1, end) if hit[0] == "trail" else ():
            if cum[i] - last >= 60 and cum[end] - cum[i] >= 30 and turn[i] >= 50 and turn[i + 1] <= turn[i]:
                out.append([i, None, 0, True, True, False])
                last = cum[i]
    bounds = [*[o[0] for o in out[1:]], n - 1]
    timed = times[0] is not None and times[-1] is not None and times[-1] > times[0]
    walked = sum(cum[e] - cum[o[0]] for o, e in zip(out, bounds) if o[3]) > cum[-1] / 2
    for o, e in zip(out, bounds):
        m, t0, t1 = cum[e] - cum[o[0]], times[o[0]], times[e]
        kmh = min(matching.TYPE_KMH.get(o[2], 50), matching.CLASS_CAP_KMH.get(hits[o[0]][3], math.inf))
        o.append((t1 - t0) / 1000 if timed and t0 is not None and t1 is not None and t1 >= t0 else m / (4 / 3.6) if o[3] or walked else m / (kmh / 3.6))
    return [tuple(o) for o in out]


def matched(spark, tracks, roads):
    points = [(k, i, *p, t) for k, (coords, times) in tracks.items() for i, (p, t) in enumerate(zip(coords, times))]
    lines = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in line], name, kind, cls) for i, (line, name, kind, cls) in enumerate(roads)], "stretch long, line array<struct<lon double, lat double>>, name string, type int, cls int")
    df = spark.createDataFrame(points, "track int, n long, lon double, lat double, time long")
    out = {}
    for r in matching.match(df, lines).orderBy("track", "n").collect():
        out.setdefault(r["track"], []).append((r["n"], r["name"], r["type"], r["trail"], r["bend"], r["highland"], pytest.approx(r["seconds"], rel=1e-6, abs=1e-6)))
        assert r["junction"] == (len(out[r["track"]]) > 1)
    return out


def test_a_track_leaves_an_f_road_for_a_trail_with_a_bend(spark):
    """1 km east along the road with a wobble, 400 m north off it, then sharply south-east."""
    coords = [(179.0 + i * 20 * MLON if i <= 50 else 179.0 + 1000 * MLON + max(0, i - 70) * 16 * MLON, LAT + ((8 if i == 25 else 3) if i <= 50 else (i - 50) * 20 if i <= 70 else 400 - (i - 70) * 12) * M) for i in range(86)]
    road = ([(179.0, LAT), (179.0 + 2000 * MLON, LAT)], "F208", 0x0A, 1)
    tracks = {1: (coords, [None] * 86), 2: (coords, [1_000_000 + i * 10_000 for i in range(86)]), 3: ([(x, y + 0.01) for x, y in coords], [None] * 86)}
    got = matched(spark, tracks, [road])
    assert [(s[1], s[3], s[4]) for s in got[1]] == [("F208", False, False), (None, True, False), (None, True, True)]
    assert got[2][0][-1] == got[2][1][0] * 10
    assert all(got[k] == by_force(*tracks[k], [road]) for k in tracks) and all(s[3] for s in got[3])


def test_matching_equals_a_plain_walk(spark):
    rng = random.Random(4)
    grid = [179.0 + e * MLON for e in (0, 300, 600, 900)]
    roads = [([(x, LAT), (x, LAT + 900 * M)], rng.choice([None, f"road {k}"]), rng.choice([1, 3, 7, 12, 33]), rng.choice([0, 0, 1, 2])) for k, x in enumerate(grid)]
    roads += [([(grid[0], LAT + y * M), (grid[2], LAT + (y + 5) * M), (grid[3], LAT + y * M)], rng.choice([None, f"way {y}"]), rng.choice([2, 5, 6]), rng.choice([0, 3])) for y in (0, 250, 280, 900)]
    tracks = {}
    for k in range(40):
        x, y, course = 179.0 + rng.uniform(-50, 900) * MLON, LAT + rng.uniform(-50, 900) * M, rng.choice([0, 90, 180, 270])
        coords = []
        for _ in range(rng.choice([1, 2, 3, 40, 120])):
            coords.append((x, y))
            course += rng.choice([0, 0, 0, 0, 0, 0, 90, -90, 120, rng.uniform(-40, 40)])
            step = rng.choice([0, 4, 9, 15, 22])
            x, y = x + step * math.sin(math.radians(course)) * MLON, y + step * math.cos(math.radians(course)) * M
        times = [None] * len(coords) if k % 3 == 0 else [rng.choice([None, i * 1000]) if rng.random() < 0.1 else i * 1000 for i in range(len(coords))]
        tracks[k if k else None] = (coords, times)
    got = matched(spark, tracks, roads)
    want = {k: by_force(*t, roads) for k, t in tracks.items()}
    assert {k: [s[:6] for s in v] for k, v in got.items()} == {k: [s[:6] for s in v] for k, v in want.items()}
    assert got == want
    assert any(s[4] for v in want.values() for s in v) and any(s[5] for v in want.values() for s in v)


def test_no_roads_and_no_points(spark):
    tracks = {1: ([(10.0 + i * MLON, LAT) for i in range(5)], [None] * 5)}
    points = spark.createDataFrame([(1, i, *p, None) for i, p in enumerate(tracks[1][0])] + [(1, 9, None, 3.0, None)], "track int, n long, lon double, lat double, time long")
    none = spark.createDataFrame([], "stretch long, line array<struct<lon double, lat double>>, name string, type int, cls int")
    assert [(r["n"], r["trail"]) for r in matching.match(points, none).collect()] == [(0, True)]
    assert matching.match(points.limit(0), none).count() == 0
