"""Folds over partitions against plain loops, with tracks that fill several partitions."""

import math
import random

import pytest

from trailspark.operators import folding, sequence


def rows_of(rng, sizes):
    rows = []
    for track, n in sizes.items():
        rows += [(track, i, rng.choice([None, float("nan"), rng.uniform(0, 50), rng.uniform(0, 50)]), rng.uniform(10, 10.001), rng.uniform(60, 60.001)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def by_force(rows, start, step, finish):
    tracks = {}
    for r in sorted(rows, key=lambda r: r[1]):
        tracks.setdefault(r[0], []).append(r)
    out = []
    for track, own in tracks.items():
        state = start
        for r in own:
            state, given = step(state, {"n": [r[1]], "v": [r[2]], "lon": [r[3]], "lat": [r[4]]})
            out += [(track, *g) for g in given]
        out += [(track, *g) for g in (finish(state) if finish else [])]
    return sorted(out, key=str)


FOLDS = {
    "climb": (sequence.climb("v"), "total double", lambda s: [(s[1],)]),
    "smoothed": (sequence.smoothed("v", 0.4), "v double", lambda s: [s]),
    "held": (sequence.held("v"), "v double", lambda s: [s]),
    "off": (sequence.off_route("v", "n", rough=1e9), "off boolean, times int", lambda s: [s[1:]]),
    "thinned": (sequence.thinned("n"), "n long, lon double, lat double", None),
    "spaced": (sequence.spaced("n", "n", 7), "n long", lambda s: [] if s[1] is None else [(s[1],)]),
}


@pytest.mark.parametrize("name", FOLDS)
@pytest.mark.parametrize("sizes", [{7: 900}, {None: 5, 1: 3, 2: 800, 3: 1, 9: 200}, {k: 3 for k in range(40)}])
def test_folds_equal_plain_loops(spark, name, sizes):
    rows = rows_of(random.Random(str(sizes)), sizes)
    df = spark.createDataFrame(rows, "track long, n long, v double, lon double, lat double")
    (start, step), out, finish = FOLDS[name]
    got = folding.folded(df, "track", ["n"], start, step, out, finish).collect()
    assert sorted(map(tuple, got), key=str) == by_force(rows, start, step, finish)


def test_nothing_to_fold(spark):
    df = spark.createDataFrame([], "track string, n long, v double")
    got = folding.folded(df, "track", ["n"], *sequence.smoothed("v", 0.4), "v double", lambda s: [s])
    assert got.columns == ["track", "v"] and got.count() == 0


def test_a_recorder_keeps_turns():
    """The way's direction counts, as it runs from the last kept fix: 4 m on after a right angle is kept, 4 m straight on isn't."""
    deg = 1 / 111_195
    start, step = sequence.thinned("n")
    east = lambda m: 10 + m * deg / math.cos(math.radians(60))
    places = [(10.0, 60.0), (east(4), 60.0), (east(11), 60.0), (east(15), 60.0), (east(11), 60 + 4 * deg), (east(11), 60 + 6 * deg), (None, 60.0), (east(11), 60 + 15 * deg)]
    state, kept = step(start, {"n": list(range(len(places))), "lon": [p[0] for p in places], "lat": [p[1] for p in places]})
    assert [k[0] for k in kept] == [0, 2, 4, 7]
    assert state[2] == pytest.approx(0.0, abs=1e-6)


def test_steps_between_unknown_places_are_unknown(spark):
    from pyspark.sql import functions as F

    from trailspark.functions import geo

    df = spark.createDataFrame([(None, 1.0), (0.0, 180.0)], "a double, b double")
    assert [r[0] if r[0] is None else round(r[0]) for r in df.select(geo.haversine_m(F.col("a"), F.lit(0.0), F.col("b"), F.lit(0.0))).collect()] == [None, 20015114]
