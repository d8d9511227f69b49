"""Fires, roads, incidents and forecasts derived from the supplied tables, which have no
coordinates: the same arithmetic in DataFrame expressions and, below, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-15 00:00:00"
START = "2024-01-01 00:00:00"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fire for each event, in places that gather around its user's."""
    lat = "36 + (user_id * 37 % 750) / 100 + (event_id * 31 % 97) / 1000"
    lon = "-9 + (user_id * 53 % 1250) / 100 + (event_id * 17 % 89) / 1000"
    return table(spark, sf_dir, "events").selectExpr("sha2(cast(event_id as string), 256) as fire_id", "event_id", "user_id", "concat('U', user_id) as cluster_id", f"{lat} as latitude", f"{lon} as longitude", "cast(ts as timestamp_ntz) as fire_detection_timestamp", "value as fire_radiative_power")


FIRES = """fires AS (SELECT sha256(event_id::VARCHAR) AS fire_id, event_id, user_id, concat('U', user_id) AS cluster_id,
  36 + (user_id * 37 % 750) / 100 + (event_id * 31 % 97) / 1000 AS lat, -9 + (user_id * 53 % 1250) / 100 + (event_id * 17 % 89) / 1000 AS lon,
  ts::TIMESTAMP AS t, value AS frp FROM events)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE p_size % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'service' END"
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as osm_way_id", "p_size % 4 as lanes_count", f"{kind} as road_classification", "36 + (p_partkey % 751) / 100 as centroid_latitude", "-9 + (p_partkey % 1153) / 100 as centroid_longitude")


ROADS = """roads AS (SELECT p_partkey::VARCHAR AS way, p_size % 4 AS lanes,
  CASE p_size % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'service' END AS kind,
  36 + (p_partkey % 751) / 100 AS rlat, -9 + (p_partkey % 1153) / 100 AS rlon FROM part)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr(f"timestamp_ntz '{START}' + make_dt_interval(0, 0, cast(o_orderkey % 43200 as int))")
    severity = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'normal' END")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("record_id"), F.expr("36 + (o_orderkey * 41 % 7510) / 1000").alias("latitude"), F.expr("-9 + (o_orderkey * 59 % 11530) / 1000").alias("longitude"), start.alias("start_timestamp"), F.when(F.col("o_orderstatus") != "O", start + F.expr("INTERVAL 6 HOURS")).alias("end_timestamp"), severity.alias("severity_level"))


INCIDENTS = """incidents AS (SELECT o_orderkey::VARCHAR AS id, 36 + (o_orderkey * 41 % 7510) / 1000 AS ilat, -9 + (o_orderkey * 59 % 11530) / 1000 AS ilon,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey % 43200)::INT) AS s,
  CASE WHEN o_orderstatus <> 'O' THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes((o_orderkey % 43200)::INT) + INTERVAL 6 HOURS END AS e,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS rank FROM orders)"""


def forecast(spark: SparkSession) -> DataFrame:
    """A grid of 0.1 degrees for each of 24 hours; values reach every score."""
    at = spark.range(80 * 130 * 24).selectExpr("cast(floor(id / 3120) as int) as i", "cast(floor(id / 24) % 130 as int) as j", "cast(id % 24 as int) as h")
    hour = F.expr(f"timestamp_ntz '{AS_OF}' + make_dt_interval(0, h)")
    return at.select(F.expr("36 + i / 10").alias("latitude"), F.expr("-9 + j / 10").alias("longitude"), hour.alias("forecast_timestamp"), F.expr("cast(15 + (i * 7 + j * 3 + h) % 25 as double)").alias("temperature_celsius"), F.expr("cast(10 + (i * 5 + j * 11 + h) % 60 as int)").alias("humidity_percentage"), F.expr("CASE WHEN (i + j + h) % 5 = 0 THEN cast(null as double) ELSE ((i * 3 + j + h) % 4) / 2 END").alias("precipitation_mm"), F.expr("cast((i * 13 + j * 7 + h * 3) % 50 as double)").alias("wind_speed_kmh"))


FORECAST = """forecast AS (SELECT 36 + i / 10 AS wlat, -9 + j / 10 AS wlon, TIMESTAMP '2024-01-15 00:00:00' + to_hours(h::INT) AS ft,
  (15 + (i * 7 + j * 3 + h) % 25)::DOUBLE AS temp, 10 + (i * 5 + j * 11 + h) % 60 AS hum,
  CASE WHEN (i + j + h) % 5 = 0 THEN NULL ELSE ((i * 3 + j + h) % 4) / 2 END AS rain, ((i * 13 + j * 7 + h * 3) % 50)::DOUBLE AS wind
  FROM range(80) a(i), range(130) b(j), range(24) c(h))"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The distance in SQL."""
    return f"(asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) * 12742.0::DOUBLE)"
