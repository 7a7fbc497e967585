"""Place search, descriptions and joins by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions import geo, text
from trailspark.operators import labels, spatial
from trailspark.plans import adapters as A
from trailspark.plans import network
from trailspark.tables import table

# Limits and radii of place search.
LIMIT, NEAR_KM, SUBSTRING = 100, 25.0, 3
QUERY, LON, LAT = "an", -20.0, 64.5

_RANK = "case kind when 'point' then 0 when 'polygon' then 1 else 2 end"
_HAV = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def _scored(df: DataFrame, query: str) -> DataFrame:
    """score: 0 for a prefix of the name, 1 for a prefix of a word, 2 for a substring of at least three characters."""
    norm = df.withColumn("norm", text.normalize(F.col("name")))
    score = F.when(F.col("norm").startswith(query), 0).when(F.contains("norm", F.lit(" " + query)), 1)
    if len(query) >= SUBSTRING:
        score = score.when(F.contains("norm", F.lit(query)), 2)
    return norm.withColumn("score", score).where("score is not null").withColumn("rank", F.expr(_RANK))


def search(df: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Places for a query in normal form, best first."""
    return _scored(df, query).orderBy("score", "rank", F.length("norm"), "name", "place_id").limit(limit)


def search_near(df: DataFrame, query: str, lon: float, lat: float, limit: int = LIMIT) -> DataFrame:
    """The same around a position: inside a score, what lies within 25 km comes first, nearest first. Exact names lead, towns before others."""
    s = _scored(df, query)
    dx = (F.col("lon") - lon) * F.cos(F.radians(F.lit(lat)))
    d2 = dx * dx + (F.col("lat") - lat) * (F.col("lat") - lat)
    limit2 = (NEAR_KM / geo.DEGREE_KM) ** 2
    s = s.withColumn("bucket", F.when(F.col("norm") == query, -1).otherwise(F.col("score"))).withColumn("near", d2 < limit2)
    town = F.when((F.col("bucket") == -1) & ~((F.col("kind") == "point") & F.shiftright(F.col("type"), 8).between(1, 13)), 1).otherwise(0)
    return s.orderBy("bucket", town, F.desc("near"), F.when(F.col("near"), d2).otherwise(0.0), "rank", F.length("norm"), "name", "place_id").limit(limit)


_NORM_SQL = "trim(regexp_replace(strip_accents(replace(replace(replace(replace(replace(lower({c}), 'þ', 'th'), 'ð', 'd'), 'æ', 'ae'), 'ö', 'o'), 'ø', 'o')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SCORED_SQL = f"""with {A.PLACES}, n as (select *, {_NORM_SQL.format(c="name")} as norm, case kind when 'point' then 0 when 'polygon' then 1 else 2 end as rank from places),
s as (select *, case when starts_with(norm, '{QUERY}') then 0 when contains(norm, ' {QUERY}') then 1 end as score from n)"""


def place_search_plain(spark: SparkSession, d: str) -> DataFrame:
    return search(A.places(spark, d), QUERY).select("place_id", "name", "score")


def place_search_near(spark: SparkSession, d: str) -> DataFrame:
    return search_near(A.places(spark, d), QUERY, LON, LAT).select("place_id", "name", "score", "near")


def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


def place_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One place of each normal name, kind and twentieth of a degree: the first."""
    p = A.places(spark, d).withColumn("norm", text.normalize(F.col("name"))).withColumn("cx", geo.js_round(F.col("lon") * 20)).withColumn("cy", geo.js_round(F.col("lat") * 20))
    return p.groupBy("norm", "kind", "cx", "cy").agg(F.min("place_id").alias("place_id"), F.count("*").alias("copies"))


def nearest_town(spark: SparkSession, d: str) -> DataFrame:
    """Each place's nearest town and how far and where it lies; for a town within half a kilometre of one, nothing is said.

    Places on the streets over the date line are among them; they are thousands of kilometres from any town.
    """
    far = network.nodes(spark, d).where("node % 10 = 3").select((-F.col("node")).alias("place_id"), "lon", "lat", F.lit("line").alias("kind"), F.lit(0).alias("type"))
    places = A.places(spark, d).select("place_id", "lon", "lat", "kind", "type").unionByName(far)
    found = spatial.nearest(places, A.towns(spark, d), "place_id", "town_id")
    b = geo.bearing(F.col("t_lon"), F.col("t_lat"), F.col("lon"), F.col("lat"))
    town = text.title_case(F.col("town"))
    where = F.when(F.col("km") < 2, F.concat(F.lit("in "), town)).when(F.col("km") < 15, F.concat(F.lit("near "), town)).otherwise(F.concat(text.search_distance(F.col("km")), F.lit(" "), geo.octant(b), F.lit(" of "), town))
    own = (F.col("kind") == "point") & F.shiftright("type", 8).between(1, 13) & (F.col("km") < 0.5)
    return found.select("place_id", "town_id", F.round("km", 3).alias("km"), F.when(~own, where).alias("described"))


def near_name(points: DataFrame, places: DataFrame, key: str, most_km: float = 3.0) -> DataFrame:
    """Each point's nearest named point place within 3 km: key, near_id, label, km. Names of digits, blanks and ``. , -`` alone don't count.

    A height at a name's end is left out of the label. Of equal distances the later place counts.
    """
    named = places.where((F.col("kind") == "point") & ~F.col("name").rlike(r"^[\d\s.,-]+$"))
    named = named.select((-F.col("place_id")).alias("_last"), F.col("place_id").alias("near_id"), F.col("name").alias("near"), F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    found = spatial.nearest(points, named, key, "_last", most_km)
    return found.select(key, "near_id", F.concat(F.lit("Near "), text.title_case(F.regexp_replace("near", r"\s+\d+\s?m$", ""))).alias("label"), "km")


def near_name_3km(spark: SparkSession, d: str) -> DataFrame:
    """Pins of customers, half of them beside a place, named after the nearest point place within 3 km."""
    pins = table(spark, d, "customer").select(F.col("c_custkey").alias("pin"), (F.lit(-24.0) + (F.col("c_custkey") * 7919 % 110000) / 10000.0 + F.col("c_custkey") % 2 * 0.013).alias("lon"), (F.lit(63.0) + (F.col("c_custkey") * 104729 % 35000) / 10000.0 + F.col("c_custkey") % 3 * 0.011).alias("lat"))
    k = F.col("place_id")
    name = F.when(k % 4 == 0, F.concat(F.upper("name"), F.lit(" "), (k % 900).cast("string"), F.lit(" m"))).when(k % 9 == 1, F.concat((k % 90).cast("string"), F.lit(" - "), (k % 7).cast("string"))).otherwise(F.col("name"))
    return near_name(pins, A.places(spark, d).withColumn("name", name), "pin").withColumn("km", F.round("km", 3))


def label_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Labels of areas made from orders, many of one name near each other, that no larger one stands for."""
    k = F.col("o_orderkey")
    ax, ay, half = k * 7919 % 100000 / 10.0, k * 104729 % 60000 / 10.0, (k % 11 + 1) * 4.0
    name = F.when(k % 13 == 0, F.concat((k % 40).cast("string"), F.lit(" street"))).when(k % 17 != 0, F.concat(F.lit("area "), (k % 97).cast("string")))
    rows = table(spark, d, "orders").select(k.alias("id"), name.alias("name"), (k % 50).alias("size"), ax.alias("ax"), ay.alias("ay"), (ax - half).alias("west"), (ay - half).alias("south"), (ax + half).alias("east"), (ay + half * 2).alias("north"))
    return labels.survivors(rows, 128.0, 100.0).select("id", "name")


def bbox_range_join(spark: SparkSession, d: str) -> DataFrame:
    b = A.boxes(spark, d)
    named = lambda s: b.select(F.col("box_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("west", "south", "east", "north")])
    return spatial.bbox_join(named("l"), named("r"), 0.5).where("l_id < r_id").select("l_id", "r_id")


def tile_xy(spark: SparkSession, d: str) -> DataFrame:
    p, z = A.places(spark, d), F.col("zoom")
    return p.withColumn("zoom", F.explode(F.sequence(F.lit(4), F.lit(14)))).groupBy("zoom", geo.tile_x(F.col("lon"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y")).agg(F.count("*").alias("n"))


def title_case_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.title_case(F.upper("p_name")).alias("title"), text.road_label(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("f "), F.col("p_size").cast("string"))).otherwise(F.upper("p_type"))).alias("road"))


def clean_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_file_name(F.col("text"))).alias("digest"))


def escaped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages' sources with some entities more, unescaped; and their escaped addresses."""
    more = F.concat("html", F.lit("&#"), (F.col("page_id") % 900 + 100).cast("string"), F.lit(";&#x1F60"), (F.col("page_id") % 10).cast("string"), F.lit(";&AMP;lt; & &no;"))
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape(more)).alias("plain"), F.md5(text.escape(F.col("url"))).alias("url"))


def format_distances(spark: SparkSession, d: str) -> DataFrame:
    km = F.col("l_extendedprice") / 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.search_distance(km).alias("search"), text.stats_distance(F.col("l_extendedprice") / 4).alias("stats"), text.stats_duration((F.col("l_extendedprice") * 3000)).alias("duration"))


def zoom_bands(spark: SparkSession, d: str) -> DataFrame:
    """Each level's zooms: from its bits less 11, held in 4 to 14, up to where the next finer one starts."""
    bits = table(spark, d, "part").select((F.col("p_size") % 8 + 14).alias("bits")).distinct()
    w = Window.orderBy("bits")  # a handful of levels
    start = F.when(F.row_number().over(w) == 1, 4).otherwise(F.greatest(F.lit(4), F.least(F.lit(14), F.col("bits") - 11)))
    s = bits.withColumn("start", start)
    return s.withColumn("until", F.coalesce(F.lead("start").over(w) - 1, F.lit(14))).where("start <= until").select("bits", "start", "until")


#: One decimal of x by its exact binary value, as text.one_decimal has it.
_ONE = "(case when {x} > (2 * floor({x} * 10 + 0.5) - 1) / 20 or {x} = (2 * floor({x} * 10 + 0.5) - 1) / 20 and ((2 * floor({x} * 10 + 0.5) - 1) / 20 * 16 - (2 * floor({x} * 10 + 0.5) - 1)) + (2 * floor({x} * 10 + 0.5) - 1) / 20 * 4 >= 0 then (floor({x} * 10 + 0.5)::bigint // 10) || '.' || (floor({x} * 10 + 0.5)::bigint % 10) else ((floor({x} * 10 + 0.5)::bigint - 1) // 10) || '.' || ((floor({x} * 10 + 0.5)::bigint - 1) % 10) end)"
_DIST = "case when x < 1 then greatest(10, floor(x * 1000 / 10 + 0.5) * 10)::bigint || ' m' when x < 10 then " + _ONE.format(x="x") + " || ' km' else floor(x + 0.5)::bigint || ' km' end"

QUERIES = {f.__name__: f for f in (place_search_plain, place_search_near, normalize_documents, place_dedupe, nearest_town, near_name_3km, label_survivors, bbox_range_join, tile_xy, title_case_parts, clean_file_names, escaped_pages, format_distances, zoom_bands)}

ORACLES = {
    "place_search_plain": f"{_SCORED_SQL} select place_id, name, score from s where score is not null order by score, rank, length(norm), name, place_id limit {LIMIT}",
    "place_search_near": f"""{_SCORED_SQL}, t as (select *, case when norm = '{QUERY}' then -1 else score end as bucket, pow((lon - {LON}) * cos(radians({LAT})), 2) + pow(lat - {LAT}, 2) as d2 from s where score is not null),
u as (select *, d2 < pow({NEAR_KM} / {geo.DEGREE_KM}, 2) as near, case when bucket = -1 and not (kind = 'point' and (type >> 8) between 1 and 13) then 1 else 0 end as town from t)
select place_id, name, score, near from u order by bucket, town, near desc, case when near then d2 else 0 end, rank, length(norm), name, place_id limit {LIMIT}""",
    "normalize_documents": f"select doc_id, md5({_NORM_SQL.format(c='text')}) as digest from documents",
    "place_dedupe": f"with {A.PLACES} select {_NORM_SQL.format(c='name')} as norm, kind, floor(lon * 20 + 0.5)::bigint as cx, floor(lat * 20 + 0.5)::bigint as cy, min(place_id) as place_id, count(*) as copies from places group by all",
    "nearest_town": f"""with {A.PLACES}, {A.TOWNS}, {network.STRETCHES}, p as (select place_id, lon, lat, kind, type from places union all select -node, lon, lat, 'line', 0 from nodes where node % 10 = 3),
m as (select p.*, t.*, {_HAV.format(r=6371.0, a='p.', b='t_').replace('t_lat', 't.t_lat').replace('t_lon', 't.t_lon')} as km from p, towns t),
b as (select *, row_number() over (partition by place_id order by km, town_id) as n from m),
c as (select *, (degrees(atan2(sin(radians(lon - t_lon)) * cos(radians(lat)), cos(radians(t_lat)) * sin(radians(lat)) - sin(radians(t_lat)) * cos(radians(lat)) * cos(radians(lon - t_lon)))) + 360) % 360 as a from b where n = 1)
select place_id, town_id, round(km, 3) as km, case when kind = 'point' and (type >> 8) between 1 and 13 and km < 0.5 then null when km < 2 then 'in ' || town when km < 15 then 'near ' || town
  else floor(km + 0.5)::bigint || ' km ' || ['N','NE','E','SE','S','SW','W','NW'][(floor(a / 45 + 0.5)::bigint % 8 + 1)] || ' of ' || town end as described from c""",
    "near_name_3km": f"""with {A.PLACES}, pins as (select c_custkey as pin, -24.0::double + (c_custkey * 7919 % 110000) / 10000.0::double + c_custkey % 2 * 0.013::double as lon, 63.0::double + (c_custkey * 104729 % 35000) / 10000.0::double + c_custkey % 3 * 0.011::double as lat from customer),
named as (select *, case when place_id % 4 = 0 then upper(name) || ' ' || (place_id % 900) || ' m' when place_id % 9 = 1 then (place_id % 90) || ' - ' || (place_id % 7) else name end as said from places where kind = 'point'),
m as (select a.pin, b.place_id as near_id, regexp_replace(said, '\\s+\\d+\\s?m$', '') as said, {_HAV.format(r=6371.0, a='a.', b='b.')} as km from pins a, named b where not regexp_matches(said, '^[\\d\\s.,-]+$')),
b as (select *, row_number() over (partition by pin order by km, near_id desc) as n from m where km <= 3)
select pin, near_id, 'Near ' || case when said = upper(said) and said <> lower(said) then array_to_string(list_transform(string_split(said, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') else said end as label, round(km, 3) as km from b where n = 1""",
    "label_survivors": """with l as materialized (select o_orderkey as id, case when o_orderkey % 13 = 0 then (o_orderkey % 40) || ' street' when o_orderkey % 17 <> 0 then 'area ' || (o_orderkey % 97) end as name, o_orderkey % 50 as size,
  o_orderkey * 7919 % 100000 / 10.0::double as ax, o_orderkey * 104729 % 60000 / 10.0::double as ay, (o_orderkey % 11 + 1) * 4.0::double as half from orders)
select id, name from l where name is null or not exists (select 1 from l o where o.name = l.name and (o.size, o.ax, o.ay) > (l.size, l.ax, l.ay)
  and ((o.ax - o.half <= l.ax + l.half and l.ax - l.half <= o.ax + o.half and o.ay - o.half <= l.ay + 2 * l.half and l.ay - l.half <= o.ay + 2 * o.half) or (not regexp_matches(l.name, '^[0-9]') and sqrt(pow(o.ax - l.ax, 2) + pow(o.ay - l.ay, 2)) < 128)))""",
    "bbox_range_join": f"with {A.BOXES} select l.box_id as l_id, r.box_id as r_id from boxes l join boxes r on l.box_id < r.box_id and l.west <= r.east and r.west <= l.east and l.south <= r.north and r.south <= l.north",
    "tile_xy": f"with {A.PLACES}, z as (select *, unnest(range(4, 15))::int as zoom from places) select zoom, floor((lon + 180) / 360 * pow(2, zoom))::bigint as x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, zoom))::bigint as y, count(*) as n from z group by all",
    "title_case_parts": """with t as (select *, case when p_partkey % 3 = 0 then p_size::varchar when p_partkey % 3 = 1 then 'f ' || p_size else upper(p_type) end as r from part)
select p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1:1]) || lower(p[2:])), '-')), ' ') as title,
  case when p_partkey % 3 = 0 then 'road ' || r when p_partkey % 3 = 1 then upper(replace(r, ' ', '')) else array_to_string(list_transform(string_split(r, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1:1]) || lower(p[2:])), '-')), ' ') end as road from t""",
    "clean_file_names": "with c as (select doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} _-]+', ' ', 'g'), ' +', ' ', 'g')) as t from documents) select doc_id, md5(case when t = '' then 'Route' else t end) as digest from c",
    "escaped_pages": """with p as (select page_id, url, string_split(html || '&#' || (page_id % 900 + 100) || ';&#x1F60' || (page_id % 10) || ';&AMP;lt; & &no;', '&') as parts from pages),
q as (select page_id, url, parts[1] || array_to_string(list_transform(parts[2:], lambda x: case
  when regexp_matches(x, '^#[0-9]{1,7};') then chr(regexp_extract(x, '^#([0-9]{1,7});', 1)::int) || regexp_extract(x, '^[^;]*;(.*)$', 1, 's')
  when regexp_matches(x, '^#[xX][0-9A-Fa-f]{1,6};') then chr(('0x' || regexp_extract(x, '^#[xX]([0-9A-Fa-f]{1,6});', 1))::int) || regexp_extract(x, '^[^;]*;(.*)$', 1, 's')
  when regexp_matches(x, '^(lt|gt|quot|apos|amp);', 'i') then case lower(regexp_extract(x, '^([a-zA-Z]+);', 1)) when 'lt' then '<' when 'gt' then '>' when 'quot' then '"' when 'apos' then chr(39) else '&' end || regexp_extract(x, '^[^;]*;(.*)$', 1, 's')
  else '&' || x end), '') as plain from p)
select page_id, md5(plain) as plain,
  md5(replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) as url from q""",
    "format_distances": f"""with v as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice / 1000 as x, l_extendedprice / 4 as m, floor(l_extendedprice * 3000 / 60000 + 0.5)::bigint as q from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, {_DIST} as search,
  case when m < 1000 then floor(m + 0.5)::bigint || ' m' when m < 10000 then {_ONE.format(x="(m / 1000)")} || ' km' else floor(m / 1000 + 0.5)::bigint || ' km' end as stats,
  case when q < 60 then q || ' min' when q < 1440 then (q // 60) || ' h' || case when q % 60 > 0 then ' ' || (q % 60) || ' min' else '' end
    when q < 2880 then '1 day' || case when q >= 1500 then ' ' || (q // 60 - 24) || ' h' else '' end else floor((q // 60) / 24 + 0.5)::bigint || ' days' end as duration from v""",
    "zoom_bands": """with b as (select distinct p_size % 8 + 14 as bits from part), s as (select bits, case when row_number() over (order by bits) = 1 then 4 else greatest(4, least(14, bits - 11)) end as start from b),
u as (select *, coalesce(lead(start) over (order by bits) - 1, 14) as until from s) select bits, start, until from u where start <= until""",
}
