"""The engine's inputs derived from the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return F.lit(-6.4) + ((key.cast("long") * 7919) % 10007) / F.lit(10007.0) * F.lit(0.5)


def lon_of(key: Column) -> Column:
    return F.lit(106.6) + ((key.cast("long") * 104729) % 10009) / F.lit(10009.0) * F.lit(0.5)


def sql_lat(key: str) -> str:
    return f"(-6.4::double + ((CAST({key} AS BIGINT) * 7919) % 10007) / 10007.0::double * 0.5::double)"


def sql_lon(key: str) -> str:
    return f"(106.6::double + ((CAST({key} AS BIGINT) * 104729) % 10009) / 10009.0::double * 0.5::double)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name (first line), address (the other lines): the whole text of each document."""
    text = F.coalesce("text", F.lit(""))
    rest = F.when(F.instr(text, "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index(text, "\n", 1).alias("name"), rest.alias("address"))


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z]+'), lambda x: x <> '')"


CORPUS = f"""
docs AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS name, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS address FROM documents),
words AS (SELECT doc_id, name, address, {sql_tokens("name")} AS nw, {sql_tokens("address")} AS aw FROM docs),
tok AS (SELECT doc_id, 'name' AS field, unnest(nw) AS term FROM words UNION ALL SELECT doc_id, 'address' AS field, unnest(aw) AS term FROM words),
post AS (SELECT field, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(nw)) FILTER (name <> '') AS an, avg(len(aw)) FILTER (address <> '') AS aa, avg(len(nw) + len(aw)) AS ad FROM words)"""


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places: doc_id, name, address."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.concat_ws(", ", "p_brand", "p_type").alias("address"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: doc_id, lat, lon, features, geom (a triangle for even keys)."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), F.array(F.concat(F.lit("segment="), "c_mktsegment")).alias("features"))
    corner = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + b).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.001, 0.0005), corner(-0.0005, 0.001))
    return rows.withColumn("geom", F.when(F.col("doc_id") % 2 == 0, ring).otherwise(F.array().cast("array<struct<lat:double,lon:double>>")))


PLACES = f"""
places AS (SELECT c_custkey AS doc_id, {sql_lat("c_custkey")} AS lat, {sql_lon("c_custkey")} AS lon, 'segment=' || c_mktsegment AS feature FROM customer)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as query points, some hundred metres from the place of their key, every fifth some kilometres away: query_id, lat, lon."""
    k = F.col("s_suppkey")
    lat = lat_of(k) + F.when(k % 5 == 0, 0.02).otherwise(0.0012) + (k % 7) * 0.0002
    return table(spark, sf_dir, "supplier").select(k.alias("query_id"), lat.alias("lat"), (lon_of(k) - 0.0008).alias("lon"))


STATIONS = f"""
stations AS (SELECT s_suppkey AS query_id, {sql_lat("s_suppkey")} + CASE WHEN s_suppkey % 5 = 0 THEN 0.02::double ELSE 0.0012::double END + (s_suppkey % 7) * 0.0002::double AS lat, {sql_lon("s_suppkey")} - 0.0008::double AS lon FROM supplier)"""


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as circles of one fence."""
    k = F.col("n_nationkey").cast("long") + 1
    return table(spark, sf_dir, "nation").select(F.lit("nations").alias("fence_name"), F.col("n_name").alias("key"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (1.0 + F.col("n_nationkey") % 7).alias("radius_km"))


CIRCLES = f"""
circles AS (SELECT n_name AS key, {sql_lat("n_nationkey + 1")} AS flat, {sql_lon("n_nationkey + 1")} AS flon, (1 + n_nationkey % 7)::double AS r FROM nation)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions of users."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("point_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("seq"), F.lit("nations").alias("fence_name"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


POSITIONS = f"""
pos AS (SELECT CAST(user_id AS VARCHAR) AS point_id, ts, event_id AS seq, {sql_lat("event_id")} AS lat, {sql_lon("event_id")} AS lon FROM events),
steps AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pos WINDOW w AS (PARTITION BY point_id ORDER BY ts, seq))"""


def hexagon(lat: Column, lon: Column, size: Column) -> Column:
    corners = [(1.0, 0.0), (0.5, 0.8), (-0.5, 0.8), (-1.0, 0.0), (-0.5, -0.8), (0.5, -0.8), (1.0, 0.0)]
    return F.array(*[F.struct((lat + size * a).alias("lat"), (lon + size * b).alias("lon")) for a, b in corners])


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as hexagonal regions."""
    k = F.col("n_nationkey").cast("long") + 1
    size = F.lit(0.02) + F.lit(0.01) * (F.col("n_nationkey") % 5)
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("region_id"), hexagon(lat_of(k), lon_of(k), size).alias("ring"), F.col("n_name").alias("village"), F.lit("sub ONE").alias("sub_district"), F.lit("").alias("district"), F.lit("PROVINCE x").alias("province")
    )


REGIONS = f"""
centers AS (SELECT n_nationkey AS region_id, n_name, {sql_lat("n_nationkey + 1")} AS clat, {sql_lon("n_nationkey + 1")} AS clon, (0.02::double + 0.01::double * (n_nationkey % 5)) AS s FROM nation),
corner(i, a, b) AS (VALUES (0, 1.0::double, 0.0::double), (1, 0.5, 0.8), (2, -0.5, 0.8), (3, -1.0, 0.0), (4, -0.5, -0.8), (5, 0.5, -0.8), (6, 1.0, 0.0)),
edges AS (SELECT region_id, p.i, clat + s * p.a AS alat, clon + s * p.b AS alon, clat + s * q.a AS blat, clon + s * q.b AS blon FROM centers, corner p JOIN corner q ON q.i = p.i + 1)"""


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as short streets: street_id, name, mid_lat, mid_lon, first, last."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("street_id"), F.col("s_name").alias("name"), lat_of(k).alias("mid_lat"), lon_of(k).alias("mid_lon"))
    end = lambda d: F.struct((F.col("mid_lat") + d).alias("lat"), (F.col("mid_lon") + 2 * d).alias("lon"))
    return rows.withColumns({"first": end(-0.002), "last": end(0.002)})


STREETS = f"""
streets AS (SELECT s_suppkey AS street_id, s_name AS name, {sql_lat("s_suppkey")} AS mlat, {sql_lon("s_suppkey")} AS mlon FROM supplier)"""


# SQL twins of the geometry expressions.
def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"((1 - cos(radians({c}) - radians({a}))) / 2 + cos(radians({a})) * cos(radians({c})) * (1 - cos(radians({d}) - radians({b}))) / 2)"
    return f"(12742.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double, {h})))))"


def sql_destination(lat: str, lon: str, bearing: int, km: float) -> tuple[str, str]:
    d, t = f"({km}::double / 6371.0::double)", f"radians({bearing}::double)"
    s = f"(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos({t}))"
    x = f"(radians({lon}) + atan2(sin({t}) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * {s}))"
    return f"degrees(asin({s}))", f"degrees(fmod({x} + 3 * pi(), 2 * pi()) - pi())"


def sql_project(lat: str, lon: str, a: tuple[str, str], b: tuple[str, str]) -> str:
    """A SELECT list item-free subquery: struct of lat and lon of the nearest point on the arc."""
    vec = lambda p: f"[cos(radians({p[0]})) * cos(radians({p[1]})), cos(radians({p[0]})) * sin(radians({p[1]})), sin(radians({p[0]}))]"
    cross = lambda u, v: f"[{u}[2] * {v}[3] - {u}[3] * {v}[2], {u}[3] * {v}[1] - {u}[1] * {v}[3], {u}[1] * {v}[2] - {u}[2] * {v}[1]]"
    dot = lambda u, v: f"({u}[1] * {v}[1] + {u}[2] * {v}[2] + {u}[3] * {v}[3])"
    return f"""(SELECT CASE WHEN {dot("na", "p")} > 0 AND {dot("bn", "p")} > 0 AND {dot("n", "n")} > 0
      THEN {{'lat': degrees(atan2(f[3], sqrt(f[1] * f[1] + f[2] * f[2]))), 'lon': degrees(atan2(f[2], f[1]))}}
      WHEN {dot("p", "a")} >= {dot("p", "b")} THEN {{'lat': {a[0]}, 'lon': {a[1]}}} ELSE {{'lat': {b[0]}, 'lon': {b[1]}}} END
    FROM (SELECT *, [p[1] - n[1] * q, p[2] - n[2] * q, p[3] - n[3] * q] AS f FROM
      (SELECT *, {cross("n", "a")} AS na, {cross("b", "n")} AS bn, {dot("p", "n")} / {dot("n", "n")} AS q FROM
        (SELECT *, {cross("a", "b")} AS n FROM (SELECT {vec(a)} AS a, {vec(b)} AS b, {vec((lat, lon))} AS p)))))"""
