"""Labels that stay, against all pairs."""

import math
import random

from trailspark.operators import labels


def test_survivors_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        x, y = (rng.uniform(0, 60), rng.uniform(0, 60)) if i % 3 else (rng.choice([1.0, 30.0]), rng.choice([2.0, 41.5]))
        w = rng.choice([0.0, 1.0, 2.0, 30.0])
        rows.append((i, rng.choice(["lake", "lake", "river", "12 road", "7", None]), float(rng.randrange(4)), x, y, x - w, y - w, x + w / 2, y + w))
    rows += [(1000 + k, *rows[k][1:]) for k in range(20)] + [(2000, "lake", None, None, None, None, None, None, None), (2001, "alone", 1.0, 5.0, 5.0, None, None, None, None)]

    def whole(r):
        size, x, y = (v or 0.0 for v in r[2:5])
        return r[1], (size, x, y), tuple(v if v is not None else d for v, d in zip(r[5:], (x, y, x, y)))

    def gone(r):
        name, size, (w, s, e, n) = whole(r)
        for o in rows:
            oname, osize, (ow, os, oe, on) = whole(o)
            if name is not None and oname == name and osize > size:
                if ow <= e and w <= oe and os <= n and s <= on or not name[0].isdigit() and math.hypot(osize[1] - size[1], osize[2] - size[2]) < 3.0:
                    return True
        return False

    df = spark.createDataFrame(rows, "id long, name string, size double, ax double, ay double, west double, south double, east double, north double")
    got = sorted(r["id"] for r in labels.survivors(df, 3.0, 5.0).collect())
    assert got == sorted(r[0] for r in rows if not gone(r)) and len(got) < len(rows) / 2
    assert labels.survivors(df.limit(0), 3.0, 5.0).count() == 0


def test_addresses_near_each_other_stay(spark):
    rows = [(1, "12 road", 2.0, 0.0, 0.0), (2, "12 road", 1.0, 2.0, 0.0), (3, "road", 2.0, 0.0, 0.0), (4, "road", 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, name string, size double, ax double, ay double").selectExpr("*", "ax west", "ay south", "ax east", "ay north")
    assert sorted(r["id"] for r in labels.survivors(df, 3.0, 5.0).collect()) == [1, 2, 3]
