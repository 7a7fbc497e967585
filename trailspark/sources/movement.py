"""Files of recorded movement: GPX by Spark's XML source, lines of time, latitude and longitude, and trips in an address.

A GPX file is one document and is read as one row, which is then taken apart inside the row's task; nothing is
shuffled. Names are matched as written in the standard, in lower case; a namespace prefix doesn't matter. Files that
hold no ``gpx`` element give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.tables import shared_folder, written

_POINT = "struct<_lat: string, _lon: string, ele: string, time: string, name: string>"
_GPX = f"name string, metadata struct<name: string>, trk array<struct<name: string, trkseg: array<struct<trkpt: array<{_POINT}>>>>>, rte array<struct<name: string, rtept: array<{_POINT}>>>, wpt array<{_POINT}>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.format("xml").option("rowTag", "gpx").option("ignoreNamespace", True).schema(_GPX).load(path)
    return read.select("*", F.col("_metadata.file_path").alias("file"), F.coalesce("metadata.name", "name").alias("title"))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _valid(points: Column) -> Column:
    """Points with a latitude and a longitude on the globe, as numbers."""
    read = F.transform(points, lambda p: F.struct(_number(p["_lat"]).alias("lat"), _number(p["_lon"]).alias("lon"), _number(p["ele"]).alias("ele"), F.try_to_timestamp(F.trim(p["time"])).alias("time"), p["name"].alias("name")))
    return F.filter(read, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))


def gpx_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, title, kind (track or route), line and part (from 0), name, n (from 0), lat, lon, ele, time of each point.

    Points off the globe or without numbers are left out first, then parts of fewer than two points; n counts what is
    left. All parts of a track carry its name.
    """
    d = _documents(spark, path)
    track = d.select("file", "title", F.lit("track").alias("kind"), F.posexplode("trk").alias("line", "t")).select("file", "title", "kind", "line", F.col("t.name").alias("name"), F.posexplode("t.trkseg").alias("part", "s"))
    route = d.select("file", "title", F.lit("route").alias("kind"), F.posexplode("rte").alias("line", "r"))
    parts = track.select("file", "title", "kind", "line", "part", "name", _valid(F.col("s.trkpt")).alias("points")).unionByName(
        route.select("file", "title", "kind", "line", F.lit(0).alias("part"), F.col("r.name").alias("name"), _valid(F.col("r.rtept")).alias("points"))
    )
    each = parts.where(F.size("points") >= 2).select("file", "title", "kind", "line", "part", "name", F.posexplode("points").alias("n", "p"))
    return each.select("file", "title", "kind", "line", "part", "name", "n", "p.lat", "p.lon", "p.ele", "p.time")


def gpx_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """file, title, n, name, lat, lon, ele, time of each waypoint on the globe."""
    return _documents(spark, path).select("file", "title", F.posexplode(_valid(F.col("wpt"))).alias("n", "p")).select("file", "title", "n", "p.name", "p.lat", "p.lon", "p.ele", "p.time")


def write_gpx(points: DataFrame, path: str, name: str, order: str) -> None:
    """GPX documents with a track for each value of ``name``, its points (lat, lon, and ele and time if there) by ``order``.

    Coordinates have six decimals, heights one, times are UTC to the second. A track is one row of its document, so
    it has to fit a task, as GPX keeps a track's points inside its element.
    """
    fixed = lambda c, digits: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double")))
    point = [fixed("lat", 6).alias("_lat"), fixed("lon", 6).alias("_lon")]
    if "ele" in points.columns:
        point.append(fixed("ele", 1).alias("ele"))
    if "time" in points.columns:
        point.append(F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))
    rows = points.groupBy(F.col(name).cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*point).alias("p")))).alias("rows"))
    tracks = rows.select("name", F.struct(F.expr("transform(rows, r -> r.p)").alias("trkpt")).alias("trkseg"))
    root = 'gpx version="1.1" creator="trailspark" xmlns="http://www.topografix.com/GPX/1/1"'
    tracks.write.format("xml").option("rootTag", root).option("rowTag", "trk").save(path)


def trip_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, time (ms), lat and lon of files with a line ``time,lat,lon`` for each fix; other lines are left out."""
    f = F.split("value", ",")
    read = spark.read.text(path).where(F.size(f) == 3)
    read = read.select(F.col("_metadata.file_path").alias("file"), F.trim(f[0]).try_cast("long").alias("time"), _number(f[1]).alias("lat"), _number(f[2]).alias("lon"))
    return read.where(F.col("time").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


#: Characters of the encoded form that an address doesn't carry as they are.
_ESCAPED = "[\\]^`{|}"


def _encoded(v: Column) -> Column:
    """A signed whole number in the encoded-polyline form: groups of five bits, the lowest first, each but the last marked."""
    s = F.when(v < 0, -2 * v - 1).otherwise(2 * v)
    group = lambda k: F.shiftright(s, 5 * k)
    return F.concat(*[F.when((F.lit(k == 0)) | (group(k) > 0), F.char(group(k).bitwiseAND(F.lit(31)) + F.when(group(k + 1) > 0, 32).otherwise(0) + 63)).otherwise("") for k in range(12)])


def trip_id(start: Column) -> Column:
    """The name under which a trip is kept, by its start (ms): the same trip handed over twice has one."""
    return F.concat(F.lit("trip-"), F.lower(F.conv(start.cast("string"), 10, 36)))


def trip_fragments(points: DataFrame, trip: str, order: str) -> DataFrame:
    """trip and fragment, the part of an address that hands a recorded trip over, from points with time (ms), lat and lon.

    Positions are whole 1e-5 degrees and times whole seconds, both as differences. Rows without any of the three take no part. A
    trip is one row, as it is one address.
    """
    w = Window.partitionBy(trip).orderBy(order)
    known = points.where("time is not null and lat is not null and lon is not null")
    e5 = lambda c: F.floor(F.col(c) * 1e5 + 0.5).cast("long")
    steps = known.select(trip, order, F.col("time").cast("long").alias("time"), e5("lat").alias("lat"), e5("lon").alias("lon")).withColumn("start", F.min("time").over(Window.partitionBy(trip)))
    second = F.floor(F.col("time") / 1000).cast("long")
    back = lambda v, first: v - F.coalesce(F.lag(v).over(w), first)
    zero = F.lit(0).cast("long")
    steps = steps.select(trip, order, "time", F.concat(_encoded(back(F.col("lat"), zero)), _encoded(back(F.col("lon"), zero))).alias("place"), _encoded(back(second, F.floor(F.col("start") / 1000).cast("long"))).alias("secs"))
    rows = steps.groupBy(trip).agg(F.min("time").alias("start"), F.max("time").alias("end"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "place", "secs"))).alias("rows"))

    def joined(c: str) -> Column:
        s = F.array_join(F.col(f"rows.{c}"), "")
        for ch in _ESCAPED:
            s = F.replace(s, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return s

    return rows.select(trip, F.concat_ws(".", F.lit("trip=1"), F.col("start").cast("string"), F.col("end").cast("string"), joined("place"), joined("secs")).alias("fragment"))


def trip_points(fragments: DataFrame, key: str) -> DataFrame:
    """key, start and end (ms), n (from 0), lat, lon and time (ms) of the points of fragments (key, fragment), with or without a ``#``.

    What isn't a trip in full gives no rows: another form, a broken escape, a character out of place, a number cut short, or times that
    aren't as many as places. Numbers are taken apart as rows, so nothing but windows over a trip's characters is needed.
    """
    form = r"^#?trip=1\.(\d+)\.(\d+)\.([^.]*)\.([^.]*)$"
    part = lambda k: F.regexp_extract("fragment", form, k)
    read = fragments.where(F.col("fragment").rlike(form)).select(F.col(key).alias("_key"), part(1).try_cast("long").alias("start"), part(2).try_cast("long").alias("end"), F.array(*[F.struct(F.lit(k).alias("kind"), F.try_url_decode(part(3 + k)).alias("s")) for k in (0, 1)]).alias("parts"))
    read = written(read.where("start is not null and end is not null and not exists(parts, p -> p.s is null)"))
    chars = read.select("_key", F.explode("parts").alias("p")).select("_key", "p.kind", F.posexplode(F.split("p.s", "")).alias("pos", "c")).where("c <> ''").withColumn("code", F.ascii("c") - 63)
    w = Window.partitionBy("_key", "kind").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("code") < 32
    chars = chars.withColumn("i", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0))).withColumn("group", F.col("pos") - F.coalesce(F.max(F.when(ends, F.col("pos"))).over(before) + 1, F.lit(0)))
    value = F.sum(F.col("code").bitwiseAND(F.lit(31)) * F.pow(F.lit(32.0), F.col("group"))).cast("long")
    numbers = chars.groupBy("_key", "kind", "i").agg(value.alias("v"), F.max(ends).alias("whole"), (F.min("code").between(0, 63) & F.max("code").between(0, 63)).alias("good"))
    numbers = written(numbers.withColumn("v", F.when(F.col("v") % 2 == 1, -(F.col("v") + 1) / 2).otherwise(F.col("v") / 2).cast("long")))
    sums = numbers.groupBy("_key").agg(F.bool_and(F.col("whole") & F.col("good")).alias("ok"), F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("places"), F.sum("kind").alias("times"))
    fine = sums.where("ok and places = 2 * times").select("_key")
    points = numbers.join(fine, "_key", "left_semi").groupBy("_key", F.when(F.col("kind") == 0, F.floor(F.col("i") / 2)).otherwise(F.col("i")).alias("n"))
    one = lambda kind, odd: F.max(F.when((F.col("kind") == kind) & (F.lit(odd is None) | (F.col("i") % 2 == (odd or 0))), F.col("v")))
    steps = points.agg(one(0, 0).alias("lat"), one(0, 1).alias("lon"), one(1, None).alias("secs")).join(read.select("_key", "start", "end"), "_key")
    upto = Window.partitionBy("_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(F.col("_key").alias(key), "start", "end", F.col("n").cast("int").alias("n"), (F.sum("lat").over(upto) / 1e5).alias("lat"), (F.sum("lon").over(upto) / 1e5).alias("lon"), ((F.floor(F.col("start") / 1000) + F.sum("secs").over(upto)) * 1000).alias("time"))


def gpx_round_trip(points: DataFrame, name: str, order: str) -> DataFrame:
    """``gpx_lines`` of what ``write_gpx`` wrote into the shared folder."""
    path = shared_folder(points.sparkSession)
    write_gpx(points, path, name, order)
    return gpx_lines(points.sparkSession, path)
