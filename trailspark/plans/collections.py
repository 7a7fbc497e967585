"""Merging, restoring and editing collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.operators import merge
from trailspark.plans import adapters as A
from trailspark.tables import table

#: The clock of these queries.
NOW = 15000
#: A clock that many of the rows' times are more than five minutes ahead of.
LATE = 12000 - merge.AHEAD_MS


def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_writer(*A.collections(spark, d), LATE)


def deletions_merge(spark: SparkSession, d: str) -> DataFrame:
    _, _, gone = A.collections(spark, d)
    return merge.deletions(gone, gone.where("id % 2 = 0").withColumn("at", F.col("at") * 40), NOW)


def restore_newer_only(spark: SparkSession, d: str) -> DataFrame:
    local, remote, gone = A.collections(spark, d)
    return merge.restorable(remote, local, gone)


def picture_sync_sets(spark: SparkSession, d: str) -> DataFrame:
    """What goes up (here only), comes down (there only) and is deleted there (deleted here)."""
    local, remote, gone = (x.select("id") for x in A.collections(spark, d))
    up = local.join(remote, "id", "left_anti").withColumn("action", F.lit("up"))
    down = remote.join(local, "id", "left_anti").join(gone, "id", "left_anti").withColumn("action", F.lit("down"))
    delete = remote.join(local, "id", "left_anti").join(gone, "id", "left_semi").withColumn("action", F.lit("delete"))
    return up.unionByName(down).unionByName(delete)


def upsert_by_id(spark: SparkSession, d: str) -> DataFrame:
    local, remote, _ = A.collections(spark, d)
    return merge.upsert(local, remote.where("id % 7 = 0"))


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Rows and deletions after every seventh row was deleted, half of these put back, and another copy restored."""
    local, remote, gone = A.collections(spark, d)
    rows, gone = merge.delete(local, gone, local.where("id % 7 = 3"), NOW)
    rows, gone = merge.put_back(rows, gone, local.where("id % 14 = 3"), NOW + 1)
    rows, gone = merge.restore(rows, gone, remote, NOW + 2)
    return rows.select("id", "added", "updated", F.lit(None).cast("long").alias("at")).unionByName(gone.select("id", F.lit(None).cast("long").alias("added"), F.lit(None).cast("long").alias("updated"), F.col("at").cast("long").alias("at")))


def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """Remote rows whose id isn't stored yet."""
    local, remote, _ = A.collections(spark, d)
    return remote.join(local.select("id"), "id", "left_anti")


def same_collections(spark: SparkSession, d: str) -> DataFrame:
    """How many rows differ either way; equal collections have none."""
    local, remote, _ = A.collections(spark, d)
    return local.exceptAll(remote).agg(F.count("*").alias("here")).crossJoin(remote.exceptAll(local).agg(F.count("*").alias("there")))  # one row each


def row_validators(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a finite, sensible position and a name, by verdict."""
    p = A.places(spark, d).withColumn("lon", F.when(F.col("place_id") % 97 == 0, 200.0).otherwise(F.col("lon"))).withColumn("lat", F.when(F.col("place_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("lat")))
    ok = ~F.isnan("lat") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & (F.length("name") > 0)
    return p.groupBy(ok.alias("ok")).agg(F.count("*").alias("n"))


def retention_last_k(spark: SparkSession, d: str) -> DataFrame:
    """The last five orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 5").select("o_custkey", "o_orderkey", "k")


def next_free_colour(spark: SparkSession, d: str) -> DataFrame:
    """The first colour of six that a nation's suppliers don't use, else the one that the count falls on."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_set((F.col("s_suppkey") * 5 % 6).cast("int")).alias("used"), F.count("*").alias("n"))
    free = F.array_except(F.sequence(F.lit(0), F.lit(5)), F.col("used"))
    return s.select("s_nationkey", F.when(F.size(free) > 0, F.array_min(free)).otherwise((F.col("n") % 6).cast("int")).alias("colour"))


def draw_level_running(spark: SparkSession, d: str) -> DataFrame:
    """Draw level: one more than the separators (size 1) up to each row of a brand."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "part").select("p_partkey", (F.sum(F.when(F.col("p_size") == 1, 1).otherwise(0)).over(w) + 1).alias("level"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A name for each brand's contents: twelve digits of the hash over its sorted rows."""
    row = F.concat_ws("\u0000", F.col("p_partkey").cast("string"), F.sha2("p_name", 256))
    return table(spark, d, "part").groupBy("p_brand").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256), 1, 12).alias("digest"))


QUERIES = {f.__name__: f for f in (lww_merge, deletions_merge, restore_newer_only, picture_sync_sets, upsert_by_id, edits, idempotent_insert, same_collections, row_validators, retention_last_k, next_free_colour, draw_level_running, content_hash)}

_CAP = NOW + merge.AHEAD_MS
ORACLES = {
    "lww_merge": f"""with {A.COLLECTIONS}, ls as (select id, coalesce(updated, added) as l from local), rs as (select id, coalesce(updated, added) as r from remote), b as (select id, l, r, least(greatest(l, r), 12000) as held from ls full join rs using (id))
select id, case when l is null or r > l then 'remote' else 'local' end as side, held as changed from b left join deleted using (id) where "at" is null or "at" < held""",
    "deletions_merge": f'''with {A.COLLECTIONS}, u as (select * from deleted union all select id, "at" * 40 from deleted where id % 2 = 0) select id, least(max("at"), {_CAP}) as "at" from u group by id''',
    "restore_newer_only": f"""with {A.COLLECTIONS} select r.id, coalesce(r.updated, r.added) as changed from remote r left join local l using (id) left join deleted using (id)
where (l.id is null or coalesce(r.updated, r.added) > coalesce(l.updated, l.added)) and ("at" is null or "at" < coalesce(r.updated, r.added))""",
    "picture_sync_sets": f"""with {A.COLLECTIONS} select id, 'up' as action from local where id not in (select id from remote)
union all select id, case when id in (select id from deleted) then 'delete' else 'down' end from remote where id not in (select id from local)""",
    "upsert_by_id": f"with {A.COLLECTIONS} select * from local where id not in (select id from remote where id % 7 = 0) union all select * from remote where id % 7 = 0",
    "edits": f"""with {A.COLLECTIONS}, cut as (select id from local where id % 7 = 3), back as (select * from local where id % 14 = 3),
gone1 as (select * from deleted where id not in (select id from cut) union all select id, {NOW} from cut where id not in (select id from back)),
gone2 as (select * from gone1 where id not in (select id from back)),
rows1 as (select * from local where id not in (select id from cut) union all select id, added, {NOW + 1} from back),
fit as (select r.* from remote r left join rows1 l using (id) left join gone2 g using (id) where (l.id is null or coalesce(r.updated, r.added) > coalesce(l.updated, l.added)) and (g.id is null or g.at < coalesce(r.updated, r.added)))
select id, added, updated, null::bigint as at from rows1 where id not in (select id from fit) union all select id, added, {NOW + 2}, null from fit
union all select id, null, null, "at" from gone2 where id not in (select id from fit)""",
    "idempotent_insert": f"with {A.COLLECTIONS} select * from remote where id not in (select id from local)",
    "same_collections": f"with {A.COLLECTIONS} select (select count(*) from (select * from local except all select * from remote)) as here, (select count(*) from (select * from remote except all select * from local)) as there",
    "row_validators": f"""with {A.PLACES}, p as (select place_id, name, case when place_id % 97 = 0 then 200.0 else lon end as lon, case when place_id % 89 = 0 then 'nan'::double else lat end as lat from places)
select not isnan(lat) and lon between -180 and 180 and lat between -90 and 90 and length(name) > 0 as ok, count(*) as n from p group by ok""",
    "retention_last_k": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as k from orders qualify k <= 5",
    "next_free_colour": """with s as (select s_nationkey, list(distinct (s_suppkey * 5 % 6)::int) as used, count(*) as n from supplier group by s_nationkey)
select s_nationkey, coalesce(list_min(list_filter(range(6), lambda c: not list_contains(used, c::int))), n % 6)::int as colour from s""",
    "draw_level_running": "select p_partkey, (sum(case when p_size = 1 then 1 else 0 end) over (partition by p_brand order by p_partkey) + 1)::bigint as level from part",
    "content_hash": "select p_brand, substr(sha256(string_agg(r, chr(10) order by r)), 1, 12) as digest from (select p_brand, p_partkey::varchar || chr(0) || sha256(p_name) as r from part) group by p_brand",
}
