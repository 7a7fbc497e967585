"""Operator 11 against its SQL on odd tables, and its arithmetic against Python's integers."""

import random

import duckdb
import numpy as np

from tests.llm.test_operators import DOCS, odd_docs
from trailspark.llm import divergence


def compared(spark, df, **how):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(divergence.SQL).fetchall()
    got = divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    return got


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, g, s, None, "x", "y", k) for k, (g, s, t) in enumerate(rows)], DOCS)


def test_audit_equals_its_sql(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcéß日" for b in "xyzüï語"] + ["The", "THE", "don't", "x1y", "é"]
    rows = []
    for _ in range(600):
        lang = rng.choice(["en", "en", "en", "de", None, ""])
        source = rng.choice([None, "", "hot", "hot", "hot", *(f"s{k}" for k in range(23))])
        rows.append((lang, source, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(12)))))
    rows += [("en", "nothing", None), ("en", "void", "123 !?"), ("fr", "alone", "un deux"), ("fr", "two", ""), ("it", "one", "ciao"), rows[0], rows[0]]
    df = rows_of(spark, rows)
    got = compared(spark, df)
    assert {r["lang"] for r in got} == {"", "en", "de", "fr"}  # a language's only source has no pairs, and no term in three documents
    compared(spark, df, shard_terms=5, slot_groups=2, turns_at_once=3)


def test_odd_and_empty_tables(spark):
    compared(spark, odd_docs(spark))
    assert divergence.audit(odd_docs(spark).limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    df = rows_of(spark, [("en", "a", "one two two three " * 50)] * 3 + [("en", "b", "one four " * 70)] * 3)
    want = compared(spark, df)
    monkeypatch.setattr(divergence, "_PIECE", 64)
    assert sorted(map(str, compared(spark, df))) == sorted(map(str, want))


def test_shares_and_gaps_are_exact():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.choice([0, 5, 10**6, 10**12, 8 * 10**15])
        v = rng.randrange(1, 10**6)
        c = rng.randrange(n + 1)
        assert divergence.share(c, n, v) == 1 + 10**9 * (c + 1) // (n + v)
    p, q = np.array([1, 10**9 + 1, 7], np.int64), np.array([10**9 + 1, 1, 3], np.int64)
    assert divergence.gap(p, q).tolist() == [(a - b) ** 2 // b for a, b in zip(p.tolist(), q.tolist())]


def test_every_pair_of_slots_meets_once(spark):
    for slots in (2, 4, 6, 10):
        df = spark.range(slots).withColumnRenamed("id", "slot")
        met = []
        for turn in range(slots - 1):
            pairs = {r[0]: r[1] for r in df.select("slot", divergence.opponent(df["slot"], slots, turn)).collect()}
            assert all(pairs[b] == a != b for a, b in pairs.items())
            met += [(a, b) for a, b in pairs.items() if a < b]
        assert sorted(met) == [(a, b) for a in range(slots) for b in range(a + 1, slots)]
