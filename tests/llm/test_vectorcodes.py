"""Operator 13 against a plain replica."""

import hashlib
import math
import random

import pytest

from trailspark.llm import vectorcodes
from trailspark.llm.common import written


def by_force(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(seeds[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = {}
            for _, v, _ in kept:
                chosen.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*chosen[k])] if k in chosen else old for k, old in enumerate(books[p])]
    out = []
    for i, v, g in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), g))
    totals = {}
    for _, _, e, g in out:
        totals[g] = totals.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, c, e, totals[g]) for i, c, e, g in out), key=str), digest


def coded(df, most_broadcast=200_000):
    books = vectorcodes.fit(df)
    got = vectorcodes.with_group_error(written(vectorcodes.encode(df, books, keep=["label"])), "label", most_broadcast)
    return sorted(map(tuple, got.select("vec_id", "code", "error", "label_error").collect()), key=str), books.sha256()


@pytest.mark.parametrize("n", [5, 300])
def test_codes_equal_the_replica(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(24)], rng.choice([None, 0, 1])) for i in range(n)]
    rows += [(3, rows[3][1], None), (3, rows[4][1], 7), (None, rows[0][1], 1), (400, None, 1), (401, [], 1), (402, [float("nan")] * 24, 1), (403, [None] + [0.5] * 23, 1), (404, [float("-inf")] * 24, None), (405, [0.0] * 24, 1)]
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    want = by_force(rows)
    assert coded(df) == want
    assert coded(df.repartition(7), most_broadcast=0) == want


def test_no_vectors_odd_lengths_and_overflow(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.fit(spark.createDataFrame([(1, None, 1), (2, [], 1)], schema)) is None
    df = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 9, 1)], schema)
    assert coded(df)[0] == [(1, "00" * 8, 0, 0), (2, None, None, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.fit(spark.createDataFrame([(1, [1.0] * 9, 1)], schema))
    with pytest.raises(Exception, match="too large"):
        vectorcodes.fit(spark.createDataFrame([(1, [1e30] * 8, 1)], schema))


def test_queries_of_empty_tables(spark, tmp_path):
    from trailspark.llm import queries

    for t in ("embeddings", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for q in ("op11_source_audit", "op12_tree_bpe", "op13_vector_codes"):
        got, whole = (queries.QUERIES[q](spark, d) for d in (str(tmp_path), "/root/testdata/sf0.001"))
        assert got.count() == 0 and got.dtypes == whole.dtypes
