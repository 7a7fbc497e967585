"""Texts and merges at the edges of their rules."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from trailspark.functions import text
from trailspark.operators import merge


def test_durations(spark):
    hour = 3_600_000
    want = {45 * 60_000: "45 min", hour * 16 // 3: "5 h 20 min", 24 * hour: "1 day", 30 * hour: "1 day 6 h", 48 * hour: "2 days", 49 * hour: "2 days", 52 * hour: "2 days", 84 * hour: "4 days"}
    got = spark.createDataFrame([(k,) for k in want], "ms long").select("ms", text.stats_duration(F.col("ms")).alias("t")).collect()
    assert {r["ms"]: r["t"] for r in got} == want


def test_one_decimal_goes_by_the_exact_value(spark):
    values = [k / 20 for k in range(200)] + [k / 1000 for k in range(0, 10_000, 7)] + [1.45, 1.55, 0.25, 9.949999999999999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.one_decimal(F.col("x"))).collect()]
    assert got == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]


def test_distances(spark):
    got = spark.createDataFrame([(850.0,), (1450.0,), (5400.0,), (54000.0,)], "m double").select(text.stats_distance(F.col("m"))).collect()
    assert [r[0] for r in got] == ["850 m", "1.4 km", "5.4 km", "54 km"]


def test_the_later_of_two_future_edits_wins(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, added long, updated long")
    gone = spark.createDataFrame([(3, 900_000)], "id long, at long")
    got = merge.last_writer(rows((1, 5, 800_000), (2, 5, None), (3, 5, 950_000)), rows((1, 5, 900_000), (2, 4, None)), gone, 0).collect()
    assert sorted(map(tuple, got)) == [(1, "remote", 300_000), (2, "local", 5)]


def test_accents_go_by_decomposition(spark):
    want = {"Þórsmörk": "thorsmork", "ÆGIR – Ǻrø": "aegir aro", "ṩố ǹ": "so n", "é x̣": "e x", "Ⅳ½ 5": "ⅳ½ 5", "...": "", "日本 ガ": "日本 カ"}
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", text.normalize(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == want


def test_entities_are_read_once(spark):
    want = {"a &lt; b &AMP; c": "a < b & c", "&amp;lt;": "&lt;", "&#65;&#x42;&#X1F600;": "AB😀", "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;", "&nbsp; & && &": "&nbsp; & && &", "&quot;x&apos;\n&gt;": "\"x'\n>", "none": "none", "": ""}
    got = spark.createDataFrame([(k,) for k in want], "s string").select("s", text.unescape(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == want
