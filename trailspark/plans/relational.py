"""Relational built-ins on the driver tables: grouping sets, set operations, approximate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.tables import table


def cube_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def rollup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def approx_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def intersect_except_keys(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).withColumn("side", F.lit("both")).unionByName(c.exceptAll(o.distinct()).withColumn("side", F.lit("idle")))


def semi_anti_customers(spark: SparkSession, d: str) -> DataFrame:
    c, big = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    kept = c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi")
    return kept.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of each region and nation: the dimension tables are small by nature and joined as Spark sees fit."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))
    by = li.groupBy("l_suppkey").agg(F.sum("cents").alias("cents"))  # before the joins: one row for each supplier
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = by.join(s, by["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "n_name").agg(F.sum("cents").alias("cents"))


QUERIES = {f.__name__: f for f in (cube_orders, rollup_lineitem, approx_distinct_users, intersect_except_keys, semi_anti_customers, nation_revenue)}

ORACLES = {
    "cube_orders": "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)",
    "rollup_lineitem": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity::bigint)::bigint as quantity from lineitem group by rollup (l_returnflag, l_linestatus)",
    "intersect_except_keys": "select k, 'both' as side from (select o_custkey as k from orders intersect select c_custkey from customer) union all select k, 'idle' from (select c_custkey as k from customer except all select distinct o_custkey from orders)",
    "semi_anti_customers": "select c_nationkey, count(*) as n from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000) group by c_nationkey",
    "nation_revenue": "select r_name, n_name, sum(floor(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint as cents from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name",
}
