"""Groups of points against the walk that defines them."""

import math
import random

import pytest

from trailspark.operators import clusters


def by_force(rows, radius):
    out, founders = {}, {}
    for by, n, x, y in sorted((r for r in rows if r[2] is not None and r[3] is not None), key=lambda r: r[1]):
        own = founders.setdefault(by, [])
        near = [((a - x) ** 2 + (b - y) ** 2, math.floor(a / radius), math.floor(b / radius), f) for f, a, b in own if (a - x) ** 2 + (b - y) ** 2 <= radius**2]
        if near:
            out[by, n] = min(near)[3]
        else:
            own.append((n, x, y))
            out[by, n] = n
    return out


@pytest.mark.parametrize("first", [3, 64])
def test_groups_equal_a_walk(spark, monkeypatch, first):
    monkeypatch.setattr(clusters, "FIRST", first)
    rng = random.Random(first)
    rows = [("map", n, rng.uniform(-300, 300), rng.uniform(-300, 300)) for n in range(400)]
    rows += [("map", 1000 + n, float(rng.randrange(-40, 40)), float(rng.randrange(-40, 40))) for n in range(400)]  # ties
    rows += [("map", 5000 - n, 900.0 + n * 7.3, 40.0 * math.sin(n / 9)) for n in range(300)]  # a way, against its order
    rows += [("spot", n * 3, 5.0 + rng.choice([0.0, 0.0, 9.9, 10.0, 10.1]), -3.0) for n in range(300)]
    rows += [(None, 1, 0.0, 0.0), (None, 2, 10.0, 0.0), (None, 3, 10.5, 0.0), (None, 4, None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "map string, n int, x double, y double")
    got = {(r["map"], r["n"]): r["founder"] for r in clusters.clustered(df, "map", 10.0).collect()}
    assert got == by_force(rows, 10.0)


def test_no_points(spark):
    assert clusters.clustered(spark.createDataFrame([], "map int, n int, x double, y double"), "map", 10.0).count() == 0
