"""Tracks and fixes: statistics, runs, folds, as-of lookups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from trailspark.functions import geo
from trailspark.operators import clusters, folding, sequence, spatial
from trailspark.plans import adapters as A
from trailspark.tables import table


def _in_order() -> WindowSpec:
    return Window.partitionBy("track").orderBy("ts", "i")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with ``m``, metres from the one before."""
    f = A.fixes(spark, d)
    prev = lambda c: F.lag(c).over(_in_order())
    return f.withColumn("m", F.coalesce(geo.haversine_m(prev("lon"), prev("lat"), F.col("lon"), F.col("lat")), F.lit(0.0)))


_STEPS = f"""{A.FIXES}, lagged as (select *, lag(lon) over v as plon, lag(lat) over v as plat from fixes window v as (partition by track order by ts, i)),
steps as (select *, case when plon is null then 0 else 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) end as m from lagged)"""


def track_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distance, duration and bounds of each track."""
    ms = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000)
    return _steps(spark, d).groupBy("track").agg(F.round(F.sum("m"), 2).alias("metres"), F.when(ms > 0, ms).alias("ms"), F.round(F.min("lon"), 6).alias("west"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lon"), 6).alias("east"), F.round(F.max("lat"), 6).alias("north"))


def cumulative_distance(spark: SparkSession, d: str) -> DataFrame:
    f = A.fixes(spark, d)
    m = F.coalesce(geo.plane_m(F.lag("lon").over(_in_order()), F.lag("lat").over(_in_order()), F.col("lon"), F.col("lat")), F.lit(0.0))
    return f.withColumn("m", m).select("i", F.round(F.sum("m").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("along"))


def _folded(rows: DataFrame, fold: tuple, out: str, finish=None) -> DataFrame:
    """A fold over each track's rows in the order of n."""
    return folding.folded(rows, "track", ["n"], *fold, out, finish)


def climb_fold(spark: SparkSession, d: str) -> DataFrame:
    total = _folded(A.fixes(spark, d).select("track", "n", "ele"), sequence.climb("ele"), "total double", lambda s: [(s[1],)])
    return total.select("track", geo.js_round(F.col("total")).alias("climb"))


def spacing_sample(spark: SparkSession, d: str) -> DataFrame:
    """Positions kept so that they lie at least 250 m apart along the track."""
    along = F.round(F.sum("m").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)), 2)
    rows = _steps(spark, d).select("track", "n", along.alias("along"), (F.col("n") - 1).alias("i"))
    kept = _folded(rows, sequence.spaced("along", "i", 250.0), "i long", lambda s: [] if s[1] is None else [(s[1],)])
    return kept.groupBy("track").agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("kept"))


def thin_track(spark: SparkSession, d: str) -> DataFrame:
    """How many fixes a recorder keeps of each track, and the last of them."""
    kept = _folded(A.fixes(spark, d).select("track", "n", "lon", "lat"), sequence.thinned("n"), "n long, lon double, lat double")
    return kept.groupBy("track").agg(F.count("*").alias("kept"), F.max("n").alias("last"))


def ema_speed(spark: SparkSession, d: str) -> DataFrame:
    end = _folded(A.fixes(spark, d).select("track", "n", "ele"), sequence.smoothed("ele", 0.4), "speed double", lambda s: [s])
    return end.select("track", F.round("speed", 6).alias("speed"))


def follow_zoom(spark: SparkSession, d: str) -> DataFrame:
    rows = A.fixes(spark, d).select("track", "n", (10 + F.floor(F.col("ele")) % 60 / 10.0).alias("ideal"))
    return _folded(rows, sequence.held("ideal"), "zoom double", lambda s: [s])


def off_route_debounce(spark: SparkSession, d: str) -> DataFrame:
    rows = A.fixes(spark, d).select("track", "n", (F.col("i") * 7 % 110).cast("double").alias("off"), "accuracy")
    return _folded(rows, sequence.off_route("off", "accuracy"), "times int", lambda s: [(s[2],)])


def mode_machine(spark: SparkSession, d: str) -> DataFrame:
    e = F.element_at(F.array(F.lit("tap"), F.lit("drag"), F.lit("tap"), F.lit("long"), F.lit("tap")), (F.col("i") % 5 + 1).cast("int"))
    rows = A.fixes(spark, d).select("track", "n", e.alias("e"))
    return _folded(rows, sequence.mode_after("e"), "mode string", lambda s: [(s[0] + " paused" * s[1],)])


def runs_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequence.runs(A.fixes(spark, d), ["track"], ["n"], "kind")


def repeat_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """A log that counts repeats: the last 40 lines of each track."""
    r = sequence.runs(A.fixes(spark, d), ["track"], ["n"], "kind")
    last = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("run")))
    return r.withColumn("back", last).where("back <= 40").select("track", "run", "kind", F.col("n").alias("times"))


def consecutive_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Fixes left after dropping those that round to the tile position of the one before."""
    f = A.fixes(spark, d).withColumn("x", geo.js_round(F.col("lon") * 1000)).withColumn("y", geo.js_round(F.col("lat") * 1000))
    same = (F.lag("x").over(_in_order()) == F.col("x")) & (F.lag("y").over(_in_order()) == F.col("y"))
    return f.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").groupBy("track").agg(F.count("*").alias("kept"))


def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    """Whole 1e-5 degrees as differences, and back as running sums; ``ok`` says that they agree."""
    e5 = A.fixes(spark, d).withColumn("e5", geo.js_round(F.col("lat") * 100000))
    delta = e5.withColumn("delta", F.col("e5") - F.coalesce(F.lag("e5").over(_in_order()), F.lit(0).cast("long")))
    back = F.sum("delta").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return delta.withColumn("back", back).groupBy("track").agg(F.sum(F.abs("delta")).alias("moved"), F.min((F.col("back") == F.col("e5")).cast("int")).alias("ok"))


def monotone_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """24-bit offsets with 2^24 added at each fall, and each range's end from the next start."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")
    raw = table(spark, d, "lineitem").withColumn("r", F.col("l_partkey") * 7919 % 16777216)
    fell = raw.withColumn("fell", F.when(F.col("r") < F.lag("r").over(w), 1).otherwise(0))
    start = fell.withColumn("start", F.col("r") + F.sum("fell").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 16777216)
    return start.withColumn("until", F.lead("start").over(w)).groupBy("l_orderkey").agg(F.max("start").alias("top"), F.sum(F.coalesce(F.col("until") - F.col("start"), F.lit(0).cast("long"))).alias("covered"))


def asof_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the latest purchase before it by the same user: an as-of join in one pass."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    kinds = e.where("event_id % 5 = 0").select("user_id", "us", F.col("event_id").alias("last_id"))
    return spatial.asof(e.where("event_id % 5 != 0").select("event_id", "user_id", "us"), kinds, ["user_id"], "us", ["last_id"]).select("event_id", "last_id")


def nearest_rank_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """p50, p95 and maximum of values by nearest rank, for each kind; ranks come from one window, not from collected lists."""
    e = table(spark, d, "events")
    w = Window.partitionBy("event_type")
    r = e.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("value", "event_id")) - 1)
    at = lambda p: F.max(F.when(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("top"))


def photos_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Photos of each day, newest day first: count, bytes and the first two distinct names."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("bytes", F.floor(F.col("value") * 1000).cast("long"))
    firsts = e.groupBy("day", "event_type").agg(F.min("event_id").alias("f"))
    names = firsts.groupBy("day").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]), 1, 2), ", ").alias("names"))
    return e.groupBy("day").agg(F.count("*").alias("photos"), F.sum("bytes").alias("bytes")).join(names, "day").orderBy(F.desc("day"))


#: Zooms of the maps, pixels across the world at zoom 0, and of a group.
ZOOMS, WORLD, GROUP_PX = (12, 16), 512.0, 56.0


def photo_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the pictures taken at all fixes on maps of two zooms: each group's first picture and how many it has."""
    f = A.fixes(spark, d).select(F.col("i").alias("n"), "lon", "lat", F.explode(F.array(*[F.lit(z) for z in ZOOMS])).alias("zoom"))
    scale = F.lit(WORLD) * F.pow(F.lit(2.0), F.col("zoom"))
    y = (1 - F.asinh(F.tan(F.radians("lat"))) / math.pi) / 2 * scale
    placed = f.select("zoom", "n", F.round((F.col("lon") + 180) / 360 * scale, 3).alias("x"), F.round(y, 3).alias("y"))
    return clusters.clustered(placed, "zoom", GROUP_PX).groupBy("zoom", F.col("founder").alias("first")).agg(F.count("*").alias("photos"))


def just_taken(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the fixes of the same user less than three minutes away."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    bucket = F.floor(F.col("us") / 180000000)
    photos = e.where("event_id % 10 = 0").select(F.col("event_id").alias("photo"), "user_id", F.col("us").alias("taken"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    fixes = e.where("event_id % 10 != 0").select(F.col("event_id").alias("fix"), "user_id", "us", bucket.alias("b"))
    return photos.join(fixes, ["user_id", "b"]).where("abs(us - taken) < 180000000").select("photo", "fix")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Recordings: fixes of a user with gaps under an hour."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def _fold(init: str, step: str, items: str, pick: str) -> str:
    """DuckDB fold: the accumulator starts as the list's first element."""
    return f"list_reduce(list_concat([{init}], {items}), lambda s, x: {step}){pick}"


_ROWS = f"with {A.FIXES}, t as (select track, list(ele order by n) as vs, list(i order by n) as ids, list(accuracy order by n) as acc from fixes group by track)"

QUERIES = {f.__name__: f for f in (track_stats, cumulative_distance, climb_fold, spacing_sample, thin_track, ema_speed, follow_zoom, off_route_debounce, mode_machine, runs_islands, repeat_coalesce, consecutive_dedupe, delta_encode, monotone_unwrap, asof_purchase, nearest_rank_quantiles, photos_by_day, photo_clusters, just_taken, session_windows)}

_RUNS = f"""with {A.FIXES}, a as (select *, case when lag(kind) over (partition by track order by n) is not distinct from kind and n > 1 then 0 else 1 end as new from fixes),
b as (select *, sum(new) over (partition by track order by n)::bigint as run from a), r as (select track, run, any_value(kind) as kind, count(*) as n, min(n) as first, max(n) as last from b group by track, run)"""

_MODE = _fold(
    "{'mode': 'off', 'paused': false, 'e': ''}",
    "case x.e when 'long' then {'mode': 'off', 'paused': false, 'e': ''} when 'drag' then {'mode': s.mode, 'paused': s.mode <> 'off', 'e': ''} when 'tap' then {'mode': case when s.paused then s.mode when s.mode = 'north' then 'heading' else 'north' end, 'paused': false, 'e': ''} else s end",
    "list_transform(ids, lambda i: {'mode': '', 'paused': false, 'e': ['tap', 'drag', 'tap', 'long', 'tap'][i % 5 + 1]})",
    "",
)

_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(lat)) * pow(sin(radians(lon - s.lon) / 2), 2))))"
_WAY = "degrees(atan2(sin(radians(lon - s.lon)) * cos(radians(lat)), cos(radians(s.lat)) * sin(radians(lat)) - sin(radians(s.lat)) * cos(radians(lat)) * cos(radians(lon - s.lon))))"

ORACLES = {
    "spacing_sample": f"""with recursive {_STEPS}, a as materialized (select track, n, count(*) over (partition by track) as top, round(sum(m) over (partition by track order by ts, i rows unbounded preceding), 2) as along from steps),
w as (select track, n, top, along, 0.0::double as mark, true as keep from a where n = 1
  union all select a.track, a.n, a.top, a.along, if(a.along - w.mark >= 250, a.along, w.mark), a.along - w.mark >= 250 or a.n = a.top from w join a on a.track = w.track and a.n = w.n + 1)
select track, string_agg((n - 1)::varchar, ',' order by n) as kept from w where keep group by track""",
    "thin_track": f"""with recursive {A.FIXES}, f as materialized (select track, n, lon, lat from fixes),
w as (select track, n, lon, lat, null::double as way, true as keep from f where n = 1
  union all select track, n, if(keep, lon2, lon), if(keep, lat2, lat), if(keep, way2, way), keep from (
    select track, n, s_lon as lon, s_lat as lat, lon2, lat2, way, way2, d >= 10 or (way is not null and d >= 3 and abs((way2 - way + 900) % 360 - 180) >= 20) as keep from (
      select f.track, f.n, s.lon as s_lon, s.lat as s_lat, f.lon as lon2, f.lat as lat2, s.way, {_HAV.replace("(lat - ", "(f.lat - ").replace("radians(lat)", "radians(f.lat)").replace("(lon - ", "(f.lon - ")} as d,
        {_WAY.replace("(lon - ", "(f.lon - ").replace("radians(lat)", "radians(f.lat)")} as way2 from w s join f on f.track = s.track and f.n = s.n + 1)))
select track, count(*) as kept, max(n) as last from w where keep group by track""",
    "follow_zoom": f"""{_ROWS} select track, {_fold("{'z': null::double, 'v': 0.0::double}", "case when s.z is null then {'z': floor(x.v / 0.5 + 0.5) * 0.5, 'v': x.v} when abs(x.v - s.z) < 0.4 then s else {'z': floor(x.v / 0.5 + 0.5) * 0.5, 'v': x.v} end", "list_transform(vs, lambda v: {'z': null::double, 'v': (10 + floor(v) % 60 / 10.0)::double})", ".z")} as zoom from t""",
    "mode_machine": f"""{_ROWS}, m as (select track, {_MODE} as m from t) select track, m.mode || case when m.paused then ' paused' else '' end as mode from m""",
    "track_stats": f"""with {_STEPS} select track, round(sum(m), 2) as metres, nullif((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000, 0) as ms,
  round(min(lon), 6) as west, round(min(lat), 6) as south, round(max(lon), 6) as east, round(max(lat), 6) as north from steps group by track""",
    "cumulative_distance": f"""with {A.FIXES}, l as (select *, lag(lon) over v as plon, lag(lat) over v as plat from fixes window v as (partition by track order by ts, i)),
s as (select *, coalesce(6371000 * sqrt(pow(radians(lon - plon) * cos(radians((lat + plat) / 2)), 2) + pow(radians(lat - plat), 2)), 0) as m from l)
select i, round(sum(m) over (partition by track order by ts, i rows unbounded preceding), 2) as along from s""",
    "climb_fold": f"""{_ROWS} select track, floor({_fold("{'ref': null::double, 'total': 0.0::double, 'v': null::double}", "case when s.ref is null or x.v < s.ref then {'ref': x.v, 'total': s.total, 'v': x.v} when x.v - s.ref >= 3 then {'ref': x.v, 'total': s.total + x.v - s.ref, 'v': x.v} else s end", "list_transform(vs, lambda v: {'ref': null::double, 'total': 0.0::double, 'v': v})", ".total")} + 0.5)::bigint as climb from t""",
    "ema_speed": f"{_ROWS} select track, round(list_reduce(vs, lambda s, v: s + 0.4 * (v - s)), 6) as speed from t",
    "runs_islands": f"{_RUNS} select * from r",
    "repeat_coalesce": f"{_RUNS} select track, run, kind, n as times from r qualify row_number() over (partition by track order by run desc) <= 40",
    "consecutive_dedupe": f"""with {A.FIXES}, p as (select *, floor(lon * 1000 + 0.5) as x, floor(lat * 1000 + 0.5) as y from fixes),
q as (select *, lag(x) over v as px, lag(y) over v as py from p window v as (partition by track order by ts, i)) select track, count(*) as kept from q where px is null or px <> x or py <> y group by track""",
    "delta_encode": f"""with {A.FIXES}, p as (select *, floor(lat * 100000 + 0.5)::bigint as e5 from fixes), q as (select *, e5 - coalesce(lag(e5) over (partition by track order by ts, i), 0) as delta from p)
select track, sum(abs(delta))::bigint as moved, 1 as ok from q group by track""",
    "monotone_unwrap": """with a as (select *, l_partkey * 7919 % 16777216 as r from lineitem), b as (select *, case when r < lag(r) over w then 1 else 0 end as fell from a window w as (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber)),
c as (select *, r + sum(fell) over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber rows unbounded preceding) * 16777216 as start from b),
e as (select *, lead(start) over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) as until from c) select l_orderkey, max(start)::bigint as top, sum(coalesce(until - start, 0))::bigint as covered from e group by l_orderkey""",
    "asof_purchase": """with e as (select event_id, user_id, epoch_us(ts) as us from events), r as (select user_id, us, max(event_id) as last_id from e where event_id % 5 = 0 group by all)
select l.event_id, r.last_id from (select * from e where event_id % 5 <> 0) l asof left join r on l.user_id = r.user_id and l.us >= r.us""",
    "nearest_rank_quantiles": """with r as (select *, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by value, event_id) - 1 as k from events)
select event_type, max(value) filter (where k = least(n - 1, floor(n * 0.5))) as p50, max(value) filter (where k = least(n - 1, floor(n * 0.95))) as p95, max(value) as top from r group by event_type""",
    "photos_by_day": """with e as (select *, strftime(ts, '%Y-%m-%d') as day, floor(value * 1000)::bigint as bytes from events), f as (select day, event_type, min(event_id) as f from e group by all),
n as (select day, array_to_string(list(event_type order by f)[1:2], ', ') as names from f group by day) select day, count(*) as photos, sum(bytes)::bigint as bytes, any_value(names) as names from e join n using (day) group by day""",
    "photo_clusters": f"""with recursive {A.FIXES}, p as materialized (select z.zoom, i as n, round((lon + 180) / 360 * {WORLD} * pow(2, z.zoom), 3) as x, round((1 - asinh(tan(radians(lat))) / pi()) / 2 * {WORLD} * pow(2, z.zoom), 3) as y from fixes, (values {", ".join(f"({z})" for z in ZOOMS)}) z(zoom)),
rest(k, zoom, n, x, y) as (select 0, zoom, n, x, y from p
  union all select k + 1, zoom, n, x, y from (select *, first_value(n) over w as fn, first_value(x) over w as fx, first_value(y) over w as fy from rest window w as (partition by zoom order by n)) where n <> fn and (x - fx) * (x - fx) + (y - fy) * (y - fy) > {GROUP_PX**2}),
founders as (select f.zoom, f.n, p.x, p.y from (select zoom, k, min(n) as n from rest group by zoom, k) f join p using (zoom, n)),
met as (select p.zoom, p.n, f.n as first, row_number() over (partition by p.zoom, p.n order by (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y), floor(f.x / {GROUP_PX}), floor(f.y / {GROUP_PX}), f.n) as k
  from p join founders f on f.zoom = p.zoom and f.n <= p.n and (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= {GROUP_PX**2})
select zoom, first, count(*) as photos from met where k = 1 group by all""",
    "just_taken": "with e as (select event_id, user_id, epoch_us(ts) as us from events) select p.event_id as photo, f.event_id as fix from e p join e f using (user_id) where p.event_id % 10 = 0 and f.event_id % 10 <> 0 and abs(f.us - p.us) < 180000000",
    "session_windows": """with a as (select user_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 3600000000 then 0 else 1 end as new from events),
b as (select *, sum(new) over (partition by user_id order by us) as s from a) select user_id, min(us) as start_us, count(*) as n from b group by user_id, s""",
    "off_route_debounce": f"""{_ROWS} select track, {_fold("{'count': 0, 'off': false, 'times': 0, 'o': 0.0::double, 'a': 0}", "case when x.o <= 25 then {'count': 0, 'off': false, 'times': s.times, 'o': 0.0::double, 'a': 0} when x.o > 50 and x.a <= 60 then {'count': s.count + 1, 'off': s.off or s.count + 1 >= 3, 'times': s.times + case when not s.off and s.count + 1 >= 3 then 1 else 0 end, 'o': 0.0::double, 'a': 0} else {'count': s.count, 'off': s.off and s.count > 0, 'times': s.times, 'o': 0.0::double, 'a': 0} end", "list_transform(list_zip(ids, acc), lambda p: {'count': 0, 'off': false, 'times': 0, 'o': (p[1] * 7 % 110)::double, 'a': p[2]})", ".times")} as times from t""",
}
