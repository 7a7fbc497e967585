"""Deterministic views of the test tables as places, tracks, roads, rasters and collections, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.tables import table


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("point"), F.lit("polygon"), F.lit("line")), (k % 3 + 1).cast("int"))
    return table(spark, d, "part").select(
        k.alias("place_id"), F.col("p_name").alias("name"), (F.lit(-24.0) + (k * 7919 % 110000) / 10000.0).alias("lon"),
        (F.lit(63.0) + (k * 104729 % 35000) / 10000.0).alias("lat"), kind.alias("kind"), (F.col("p_size") * 256).alias("type"),
    )


PLACES = """places as (select p_partkey as place_id, p_name as name, -24.0::double + (p_partkey * 7919 % 110000) / 10000.0::double as lon,
  63.0::double + (p_partkey * 104729 % 35000) / 10000.0::double as lat, ['point','polygon','line'][(p_partkey % 3 + 1)::int] as kind, p_size * 256 as type from part)"""


def towns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("town_id"), F.col("s_name").alias("town"), (F.lit(-24.0) + (k * 7919 % 110000) / 10000.0).alias("t_lon"), (F.lit(63.0) + (k * 104729 % 35000) / 10000.0).alias("t_lat"))


TOWNS = """towns as (select s_suppkey as town_id, s_name as town, -24.0::double + (s_suppkey * 7919 % 110000) / 10000.0::double as t_lon,
  63.0::double + (s_suppkey * 104729 % 35000) / 10000.0::double as t_lat from supplier)"""


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """Positions of users: running sums of small steps in 1e-5 degrees, so that they are whole numbers first."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("track"), F.col("event_id").alias("i"), F.col("ts"), F.col("value").alias("ele"), F.col("event_type").alias("kind"),
        (F.lit(-20.0) + F.sum(k * 37 % 201 - 100).over(w) / 100000.0).alias("lon"), (F.lit(64.0) + F.sum(k * 53 % 201 - 100).over(w) / 100000.0).alias("lat"),
        (k * 37 % 90).cast("int").alias("accuracy"), (k * 53 % 360).cast("double").alias("heading"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"),
    )


FIXES = """fixes as (select user_id as track, event_id as i, ts, value as ele, event_type as kind,
  -20.0::double + sum(event_id * 37 % 201 - 100) over w / 100000.0::double as lon, 64.0::double + sum(event_id * 53 % 201 - 100) over w / 100000.0::double as lat,
  (event_id * 37 % 90)::int as accuracy, (event_id * 53 % 360)::double as heading, row_number() over w as n
  from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Two roads from each node: to the next one and to one far away; whole-number costs."""
    p = table(spark, d, "part")
    p = p.crossJoin(F.broadcast(p.agg(F.max("p_partkey").alias("n"))))  # one row
    k = F.col("p_partkey")
    near = p.where("p_partkey % 7 != 0").select(k.alias("src"), (k % F.col("n") + 1).alias("dst"), (F.col("p_size") + 1).cast("long").alias("cost"))
    far = p.where("p_partkey % 5 = 0").select(k.alias("src"), (k * 31 % F.col("n") + 1).alias("dst"), (F.col("p_size") * 2 + 3).cast("long").alias("cost"))
    return near.unionByName(far)


EDGES = """edges as (select p_partkey as src, p_partkey % n + 1 as dst, (p_size + 1)::bigint as cost from part, (select max(p_partkey) as n from part) where p_partkey % 7 <> 0
  union all select p_partkey, p_partkey * 31 % n + 1, (p_size * 2 + 3)::bigint from part, (select max(p_partkey) as n from part) where p_partkey % 5 = 0)"""

#: Columns of the raster made from parts.
COLS = 40


def raster(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / COLS).alias("row"), (k % COLS).alias("col"), F.floor("p_retailprice").cast("long").alias("h"))


RASTER = f"raster as (select p_partkey // {COLS} as row, p_partkey % {COLS} as col, floor(p_retailprice)::bigint as h from part)"


def collections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Local rows, remote rows and deletions, from orders; times in ms are small whole numbers."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    local = o.where("o_orderkey % 3 != 0").select(k.alias("id"), (k * 17 % 10007).alias("added"), F.when(k % 2 == 0, k * 29 % 20011).alias("updated"))
    remote = o.where("o_orderkey % 3 != 1").select(k.alias("id"), (k * 17 % 10007).alias("added"), F.when(k % 5 != 0, k * 31 % 20011).alias("updated"))
    deleted = o.where("o_orderkey % 11 = 0").select(k.alias("id"), (k * 13 % 20011).alias("at"))
    return local, remote, deleted


COLLECTIONS = """local as (select o_orderkey as id, o_orderkey * 17 % 10007 as added, case when o_orderkey % 2 = 0 then o_orderkey * 29 % 20011 end as updated from orders where o_orderkey % 3 <> 0),
remote as (select o_orderkey as id, o_orderkey * 17 % 10007 as added, case when o_orderkey % 5 <> 0 then o_orderkey * 31 % 20011 end as updated from orders where o_orderkey % 3 <> 1),
deleted as (select o_orderkey as id, o_orderkey * 13 % 20011 as "at" from orders where o_orderkey % 11 = 0)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = F.lit(-24.0) + (k * 7919 % 110000) / 10000.0, F.lit(63.0) + (k * 104729 % 35000) / 10000.0
    half = (k % 7 + 1) / 16.0
    return table(spark, d, "supplier").select(k.alias("box_id"), (lon - half).alias("west"), (lat - half).alias("south"), (lon + half).alias("east"), (lat + half).alias("north"))


BOXES = """boxes as (select k as box_id, lon - half as west, lat - half as south, lon + half as east, lat + half as north from (
  select s_suppkey as k, -24.0::double + (s_suppkey * 7919 % 110000) / 10000.0::double as lon, 63.0::double + (s_suppkey * 104729 % 35000) / 10000.0::double as lat, (s_suppkey % 7 + 1) / 16.0::double as half from supplier))"""
