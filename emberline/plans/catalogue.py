"""Every query by name, and its SQL. Decision tables are reduced to their keys and what
they derive; times leave as seconds, so that no zone matters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import in_region
from ..functions.temporal import detection_time, epoch_s
from ..operators import audit, merge, spatial, tables
from ..operators.keyed import KeyedTable
from ..operators.storage import shared_dir
from ..sources import files
from ..sources.files import ROADS_JSON, road_rows
from ..sources.grid import weather_grid as grid_points
from ..sources.xml import flatten_xml
from ..streaming import snapshots
from ..streaming.upsert import replay
from . import gold, silver
from .declared import FIRE_EXPOSURE, decision_table
from .derived import AS_OF, FIRES, FORECAST, INCIDENTS, ROADS, fires, forecast, incidents, km, ntz, roads, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NEAR_ROADS = f"m AS (SELECT * FROM (SELECT *, {km('lat', 'lon', 'rlat', 'rlon')} AS d FROM fires JOIN roads ON rlat BETWEEN lat - 0.25::DOUBLE AND lat + 0.25::DOUBLE AND rlon BETWEEN lon - 0.35::DOUBLE AND lon + 0.35::DOUBLE) WHERE d <= 25)"
ROAD_BOX = "b AS (SELECT way, id, s, e, rank FROM roads JOIN incidents ON ilat BETWEEN rlat - 0.05::DOUBLE AND rlat + 0.05::DOUBLE AND ilon BETWEEN rlon - 0.07::DOUBLE AND rlon + 0.07::DOUBLE)"
APART = "abs(floor(epoch(t)) - floor(epoch(s)))"
ACTIVE = "(s <= t AND (e IS NULL OR e >= t))"
LABEL = "CASE coalesce(rank, 1) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'NORMAL' END"


def _placed(fires: DataFrame) -> DataFrame:
    """Fires by event_id, without their long ids and what no pair is asked for: each row
    is in hundreds of pairs."""
    return fires.select("event_id", "latitude", "longitude", "fire_detection_timestamp")


@query(f"WITH {FIRES}, {ROADS}, {NEAR_ROADS} SELECT event_id, way AS osm_way_id, round(d, 6) AS distance_km, CASE WHEN d <= 5 THEN 'HIGH' WHEN d <= 15 THEN 'MEDIUM' WHEN d <= 25 THEN 'LOW' ELSE 'NONE' END AS exposure_level FROM m")
def exposure_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold.fire_exposure(gold.fire_roads(_placed(fires(spark, sf_dir)), roads(spark, sf_dir)))
    return out.select("event_id", "osm_way_id", F.round("distance_to_fire_km", 6).alias("distance_km"), "exposure_level")


@query(f"""WITH {FIRES}, {FORECAST}, r AS (SELECT * FROM fires WHERE t BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND TIMESTAMP '{AS_OF}'),
c AS (SELECT *, {km('lat', 'lon', 'wlat', 'wlon')} AS d FROM r JOIN forecast ON wlat BETWEEN lat - 0.25::DOUBLE AND lat + 0.25::DOUBLE AND wlon BETWEEN lon - 0.35::DOUBLE AND lon + 0.35::DOUBLE WHERE ft >= TIMESTAMP '{AS_OF}'),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id, t, ft ORDER BY round(d, 6), wlat, wlon) AS k FROM c WHERE d <= 25),
x AS (SELECT *, CASE WHEN temp >= 35 THEN 3 WHEN temp >= 30 THEN 2 WHEN temp >= 25 THEN 1 ELSE 0 END AS s1, CASE WHEN hum < 20 THEN 3 WHEN hum < 30 THEN 2 WHEN hum < 40 THEN 1 ELSE 0 END AS s2,
  CASE WHEN wind >= 40 THEN 3 WHEN wind >= 25 THEN 2 WHEN wind >= 15 THEN 1 ELSE 0 END AS s3, CASE WHEN coalesce(rain, 0) = 0 THEN 2 WHEN rain < 1 THEN 1 ELSE 0 END AS s4,
  CASE WHEN frp >= 100 THEN 3 WHEN frp >= 50 THEN 2 WHEN frp >= 10 THEN 1 ELSE 0 END AS s5 FROM n WHERE k = 1)
SELECT event_id, floor(epoch(ft))::BIGINT AS forecast_s, round(wlat, 6) AS weather_latitude, round(wlon, 6) AS weather_longitude, round(d, 6) AS weather_distance_km, s1::INT AS temperature_score, s2::INT AS humidity_score, s3::INT AS wind_score, s4::INT AS precipitation_score, s5::INT AS fire_intensity_score,
  (s1 + s2 + s3 + s4 + s5)::INT AS fire_risk_score, CASE WHEN s1 + s2 + s3 + s4 + s5 >= 12 THEN 'CRITICAL' WHEN s1 + s2 + s3 + s4 + s5 >= 9 THEN 'HIGH' WHEN s1 + s2 + s3 + s4 + s5 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS fire_risk_level FROM x""")
def risk_nearest_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold.fire_risk(fires(spark, sf_dir), forecast(spark), ntz(AS_OF))
    scores = ["temperature_score", "humidity_score", "wind_score", "precipitation_score", "fire_intensity_score", "fire_risk_score"]
    return out.select("event_id", epoch_s(F.col("forecast_timestamp")).alias("forecast_s"), *(F.round(c, 6).alias(c) for c in ("weather_latitude", "weather_longitude", "weather_distance_km")), *scores, "fire_risk_level")


CLUSTERS_BY_USER = "u AS (SELECT cluster_id, min(t) AS t0, max(t) AS t1, count(DISTINCT fire_id) AS n, avg(lat) AS clat, avg(lon) AS clon, max(frp) AS mx, avg(frp) AS av FROM fires GROUP BY cluster_id)"


@query(f"""WITH {FIRES}, {CLUSTERS_BY_USER}, l AS (SELECT f.*, lag(frp) OVER (PARTITION BY cluster_id ORDER BY t, fire_id) AS p FROM fires f)
SELECT event_id, round(p, 6) AS previous_frp, round(coalesce(frp - p, 0), 2) AS frp_change_mw, CASE WHEN p IS NULL THEN 'NEW' WHEN frp > p THEN 'WORSENING' WHEN frp < p THEN 'IMPROVING' ELSE 'STABLE' END AS evolution_trend,
  CASE WHEN frp >= 100 THEN 'VERY_HIGH' WHEN frp >= 50 THEN 'HIGH' WHEN frp >= 10 THEN 'MEDIUM' WHEN frp >= 0 THEN 'LOW' ELSE 'UNKNOWN' END AS fire_intensity_level, (CASE WHEN frp >= 100 THEN 4 WHEN frp >= 50 THEN 3 WHEN frp >= 10 THEN 2 WHEN frp >= 0 THEN 1 ELSE 0 END)::INT AS fire_intensity_score,
  year(t)::INT AS detection_year, month(t)::INT AS detection_month, day(t)::INT AS detection_day, hour(t)::INT AS detection_hour, minute(t)::INT AS detection_minute, n AS cluster_detection_count, floor(epoch(t0))::BIGINT AS cluster_first_s, round(av, 9) AS cluster_avg_frp FROM l JOIN u USING (cluster_id)""")
def evolution_lag_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fires(spark, sf_dir)
    out = gold.fire_evolution(f, spatial.cluster_summary(f))
    parts = [f"detection_{p}" for p in ("year", "month", "day", "hour", "minute")]
    return out.select("event_id", F.round("previous_frp", 6).alias("previous_frp"), "frp_change_mw", "evolution_trend", "fire_intensity_level", "fire_intensity_score", *parts, "cluster_detection_count", epoch_s(F.col("cluster_first_detection_timestamp")).alias("cluster_first_s"), F.round("cluster_avg_frp", 9).alias("cluster_avg_frp"))


@query(f"""WITH {FIRES}, {INCIDENTS}, j AS (SELECT *, {km('lat', 'lon', 'ilat', 'ilon')} AS d, {APART} AS a, coalesce({ACTIVE}, false) AS act FROM fires JOIN incidents ON ilat BETWEEN lat - 0.25::DOUBLE AND lat + 0.25::DOUBLE AND ilon BETWEEN lon - 0.35::DOUBLE AND lon + 0.35::DOUBLE)
SELECT event_id, id AS traffic_incident_id, round(d, 6) AS distance_km, round(a / 60, 6) AS temporal_difference_minutes, act AS incident_active, CASE WHEN act AND d <= 5 THEN 'HIGH' WHEN act AND d <= 15 THEN 'MEDIUM' WHEN act AND d <= 25 THEN 'LOW' WHEN d <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS potential_fire_impact,
  CASE WHEN act AND d <= 5 AND rank >= 3 THEN 'CRITICAL' WHEN act AND d <= 5 THEN 'HIGH' WHEN act AND d <= 15 THEN 'MEDIUM' WHEN d <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS impact_level FROM j WHERE d <= 25 AND (a <= 10800 OR act)""")
def traffic_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gold.fire_traffic_impact(_placed(fires(spark, sf_dir)), incidents(spark, sf_dir))
    return out.select("event_id", "traffic_incident_id", F.round("distance_km", 6).alias("distance_km"), F.round("temporal_difference_minutes", 6).alias("temporal_difference_minutes"), F.col("incident_active_at_fire_detection").alias("incident_active"), "potential_fire_impact", "impact_level")


@query(f"""WITH {FIRES}, {ROADS}, {INCIDENTS}, {NEAR_ROADS}, {ROAD_BOX}, c AS (SELECT event_id, m.way, count(DISTINCT id) AS n, count(DISTINCT CASE WHEN {ACTIVE} THEN id END) AS na, max(rank) AS rank FROM m JOIN b ON m.way = b.way WHERE {APART} <= 10800 OR {ACTIVE} GROUP BY ALL)
SELECT m.event_id, m.way AS osm_way_id, round(d, 6) AS distance_km, coalesce(n, 0) AS traffic_incident_count, coalesce(na, 0) AS active_traffic_incident_count, {LABEL} AS max_traffic_severity,
  CASE WHEN coalesce(na, 0) > 0 AND d <= 5 THEN 'HIGH' WHEN d <= 5 THEN 'MEDIUM' WHEN d <= 15 THEN 'LOW' ELSE 'VERY_LOW' END AS road_impact_level FROM m LEFT JOIN c ON m.event_id = c.event_id AND m.way = c.way""")
def road_impact_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roads(spark, sf_dir)
    out = gold.fire_road_impact(gold.RoadsNear(_placed(fires(spark, sf_dir)), r), gold.road_incidents(r, incidents(spark, sf_dir)))
    return out.select("event_id", "osm_way_id", F.round("distance_fire_road_km", 6).alias("distance_km"), "traffic_incident_count", "active_traffic_incident_count", "max_traffic_severity", "road_impact_level")


@query(f"""WITH {FIRES}, {ROADS}, {INCIDENTS}, {NEAR_ROADS}, {ROAD_BOX}, c AS (SELECT event_id, m.way, count(DISTINCT id) AS n, max(rank) AS rank FROM m JOIN b ON m.way = b.way WHERE {ACTIVE} GROUP BY ALL),
x AS (SELECT m.event_id, m.way, d, coalesce(n, 0) AS n, coalesce(c.rank, 1) AS rank, CASE WHEN d >= 15 THEN 5 WHEN d >= 10 THEN 4 WHEN d >= 5 THEN 3 WHEN d >= 2 THEN 2 ELSE 0 END AS a, CASE WHEN lanes >= 3 THEN 5 WHEN lanes = 2 THEN 4 WHEN lanes = 1 THEN 2 ELSE 1 END AS b,
  CASE WHEN coalesce(n, 0) = 0 THEN 5 WHEN c.rank = 4 THEN 0 WHEN c.rank = 3 THEN 1 WHEN n = 1 THEN 3 ELSE 1 END AS t2, CASE kind WHEN 'motorway' THEN 5 WHEN 'trunk' THEN 4 WHEN 'primary' THEN 3 WHEN 'secondary' THEN 3 ELSE 2 END AS k FROM m LEFT JOIN c ON m.event_id = c.event_id AND m.way = c.way)
SELECT event_id, way AS osm_way_id, n AS active_traffic_incident_count, {LABEL} AS traffic_severity, a::INT AS distance_score, b::INT AS capacity_score, t2::INT AS traffic_score, k::INT AS road_type_score, (a + b + t2 + k)::INT AS evacuation_suitability_score,
  CASE WHEN a + b + t2 + k >= 16 THEN 'PREFERRED' WHEN a + b + t2 + k >= 12 THEN 'MONITOR' WHEN a + b + t2 + k >= 8 THEN 'CAUTION' ELSE 'AVOID' END AS evacuation_category FROM x""")
def evacuation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = roads(spark, sf_dir)
    out = gold.evacuation_routes(gold.RoadsNear(_placed(fires(spark, sf_dir)), r), gold.road_incidents(r, incidents(spark, sf_dir)))
    return out.select("event_id", "osm_way_id", "active_traffic_incident_count", "traffic_severity", "distance_score", "capacity_score", "traffic_score", "road_type_score", "evacuation_suitability_score", "evacuation_category")


COMPONENTS = f"""{FIRES}, pairs AS (SELECT a.fire_id AS x, b.fire_id AS y FROM fires a JOIN fires b ON b.lat BETWEEN a.lat - 0.05 AND a.lat + 0.05 AND b.lon BETWEEN a.lon - 0.07 AND a.lon + 0.07
  WHERE a.fire_id <> b.fire_id AND abs(floor(epoch(a.t)) - floor(epoch(b.t))) <= 86400 AND {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5),
reach(x, y) AS (SELECT fire_id, fire_id FROM fires UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
roots AS (SELECT x AS fire_id, concat('INC_', left(min(y), 12)) AS cid FROM reach GROUP BY x)"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fires(spark, sf_dir).drop("cluster_id")
    return f.join(spatial.assign_clusters(f), "fire_id")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT event_id, cid AS cluster_id FROM fires JOIN roots USING (fire_id)")
def cluster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).select("event_id", "cluster_id")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT cid AS cluster_id, floor(epoch(min(t)))::BIGINT AS first_s, floor(epoch(max(t)))::BIGINT AS last_s, count(DISTINCT fire_id) AS detection_count, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max, round(avg(lat), 9) AS centroid_latitude, round(avg(lon), 9) AS centroid_longitude, max(frp) AS max_frp, round(avg(frp), 9) AS avg_frp FROM fires JOIN roots USING (fire_id) GROUP BY cid")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.cluster_summary(_clustered(spark, sf_dir))
    return out.select("cluster_id", epoch_s(F.col("first_detection_timestamp")).alias("first_s"), epoch_s(F.col("last_detection_timestamp")).alias("last_s"), "detection_count", *(F.round(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")), *(F.round(c, 9).alias(c) for c in ("centroid_latitude", "centroid_longitude")), F.col("max_fire_radiative_power").alias("max_frp"), F.round("avg_fire_radiative_power", 9).alias("avg_frp"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH u AS (SELECT o_custkey AS k, o_orderdate AS placed, o_orderkey AS id, o_totalprice AS price, NULL AS status FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT k, id, price, status FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY placed DESC NULLS LAST, id) AS r FROM u) WHERE r = 1""")
def dedup_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("placed"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    edge = ntz("1998-01-01 00:00:00")
    both = tables.union_by_name(o.where(F.col("placed") < edge).drop("status"), o.where(F.col("placed") >= edge).drop("price"))
    return tables.latest_per_key(both, ["k"], "placed", ["id"]).select("k", "id", "price", "status")


@query("SELECT id, lat, lon FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 > 0 THEN 20 + (c_custkey * 13 % 300) / 10 END AS lat, -20 + (c_custkey * 7 % 300) / 10 AS lon FROM customer) WHERE lat BETWEEN 27 AND 44 AND lon BETWEEN -18.5::DOUBLE AND 5")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "CASE WHEN c_custkey % 17 > 0 THEN 20 + (c_custkey * 13 % 300) / 10 END as lat", "-20 + (c_custkey * 7 % 300) / 10 as lon")
    return in_region(points, "lat", "lon")


def _two_loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a stored table (up to 1998) and as a later load (from 1997), in which
    urgent ones have another price."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderpriority")
    old = o.where(F.col("o_orderdate") < ntz("1999-01-01 00:00:00")).select("id", "status", "price", F.lit("a.csv").alias("landing_source_file"), ntz("2024-01-01 00:00:00").alias("ingestion_timestamp"))
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("price") + 1).otherwise(F.col("price"))
    new = o.where(F.col("o_orderdate") >= ntz("1997-01-01 00:00:00")).select("id", "status", price.alias("price"), F.lit("b.csv").alias("landing_source_file"), ntz("2024-01-02 00:00:00").alias("ingestion_timestamp"))
    return old, new


def _merged(spark: SparkSession, loads: list[merge.Merge], keys: list[str]) -> DataFrame:
    """A stored table after the loads."""
    stored = KeyedTable(spark, shared_dir(spark, "merged"), keys)
    for load in loads:
        stored.merge(load)
    return stored.read()


LOADS = """o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS d, o_orderpriority AS p FROM orders), t AS (SELECT id, status, price FROM o WHERE d < TIMESTAMP '1999-01-01'),
s AS (SELECT id, status, CASE WHEN p = '1-URGENT' THEN price + 1 ELSE price END AS price FROM o WHERE d >= TIMESTAMP '1997-01-01')"""


@query(f"""WITH {LOADS}, m AS (SELECT coalesce(t.id, s.id) AS id, t.id AS ti, s.id AS si, t.status AS ts, s.status AS ss, t.price AS tp, s.price AS sp, t.id IS NOT NULL AND s.id IS NOT NULL AND (t.status IS DISTINCT FROM s.status OR t.price IS DISTINCT FROM s.price) AS ch FROM t FULL JOIN s ON t.id = s.id)
SELECT id, CASE WHEN ti IS NULL OR ch THEN ss ELSE ts END AS status, CASE WHEN ti IS NULL OR ch THEN sp ELSE tp END AS price, CASE WHEN ti IS NULL THEN 'b.csv' ELSE 'a.csv' END AS landing_source_file, CASE WHEN ch THEN 'b.csv' END AS updated_source_file FROM m""")
def merge_conditional_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_loads(spark, sf_dir)
    now = ntz("2024-01-03 00:00:00")
    out = _merged(spark, [merge.lineage_merge(load, ["id"], now) for load in (old, new)], ["id"])
    return out.select("id", "status", "price", "landing_source_file", "updated_source_file")


@query(f"WITH {LOADS} SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL THEN t.status ELSE s.status END AS status, CASE WHEN s.id IS NULL THEN t.price ELSE s.price END AS price, CASE WHEN s.id IS NULL THEN 'a.csv' ELSE 'b.csv' END AS landing_source_file FROM t FULL JOIN s ON t.id = s.id")
def merge_upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_loads(spark, sf_dir)
    now = ntz("2024-01-03 00:00:00")
    return _merged(spark, [merge.upsert_merge(load, ["id"], now) for load in (old, new)], ["id"]).select("id", "status", "price", "landing_source_file")


@query(f"WITH {INCIDENTS}, cur AS (SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') SELECT id AS record_id, floor(epoch(CASE WHEN e IS NULL AND id NOT IN (SELECT id FROM cur) THEN TIMESTAMP '{AS_OF}' ELSE e END))::BIGINT AS end_s, e IS NULL AND id NOT IN (SELECT id FROM cur) AS closed FROM incidents")
def merge_snapshot_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= ntz("1997-01-01 00:00:00")).select(F.col("o_orderkey").cast("string").alias("record_id"))
    stored = incidents(spark, sf_dir).withColumns({"ingestion_timestamp": ntz("2024-01-14 00:00:00"), "updated_timestamp": F.lit(None).cast("timestamp_ntz")})
    out = merge.close_missing(stored, current, "record_id", ntz(AS_OF), ntz(AS_OF))
    return out.select("record_id", epoch_s(F.col("end_timestamp")).alias("end_s"), F.col("updated_timestamp").isNotNull().alias("closed"))


@query("SELECT vec_id, i AS pos, embedding[i + 1]::DOUBLE AS value, CASE WHEN i < 32 THEN embedding[i + 1]::DOUBLE END AS half FROM embeddings, range(64) r(i) WHERE i < len(embedding)")
def positional_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    out = tables.unnest_parallel(e, {"value": F.col("embedding"), "half": F.slice("embedding", 1, 32)}, ["vec_id"], index="pos", driver="value")
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"), F.col("half").cast("double").alias("half"))


@query("SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, sha256(concat_ws('|', event_id::VARCHAR, value::VARCHAR, event_type)) AS fire_id FROM events")
def hash_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", silver.fire_id("event_id", "value", "event_type").alias("fire_id"))


@query("SELECT event_id, CASE WHEN event_id % 100 < 60 AND event_id % 2500 < 2400 THEN 1705276800 + (event_id % 2500) // 100 * 3600 + event_id % 100 * 60 END::BIGINT AS detected_s FROM events")
def acq_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = detection_time(F.lit("2024-01-15").cast("date"), (F.col("event_id") % 2500).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", epoch_s(at).alias("detected_s"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'works' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'stopped' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'tree' END, 'unknown') AS incident_detail_type FROM orders")
def coalesce_detail_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = [F.when(F.col("o_orderstatus") == "P", "works"), F.when(F.col("o_orderpriority") == "1-URGENT", "stopped"), F.when(F.col("o_orderpriority") == "2-HIGH", "tree")]
    return table(spark, sf_dir, "orders").select("o_orderkey", silver.detail_type(*tags).alias("incident_detail_type"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).select("record_id", F.when(F.col("severity_level") != "normal", F.col("severity_level")).alias("severity_level"), F.when(F.col("severity_level") == "high", F.lit(float("nan"))).otherwise(F.round("latitude", 3)).alias("latitude"), epoch_s(F.col("end_timestamp")).alias("end_s"))


SPARSE = f"{INCIDENTS}, p AS (SELECT id AS record_id, CASE rank WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' END AS severity_level, CASE WHEN rank = 3 THEN 'nan'::DOUBLE ELSE round(ilat, 3) END AS latitude, floor(epoch(e))::BIGINT AS end_s FROM incidents)"
COLUMNS = ("record_id", "severity_level", "latitude", "end_s")


@query(f"WITH {SPARSE} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(100.0 * count({c}) / count(*), 2)::DOUBLE AS completeness FROM p" for c in COLUMNS))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.completeness(_sparse(spark, sf_dir))


def _profile_sql(c: str) -> str:
    v = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if c == "latitude" else c
    low, high = (f"min({v})::VARCHAR", f"max({v})::VARCHAR") if c in ("latitude", "end_s") else ("NULL", "NULL")
    return f"SELECT '{c}' AS column_name, (count(*) - count({v}))::BIGINT AS null_count, round(100.0 * (count(*) - count({v})) / count(*), 2)::DOUBLE AS null_percent, count(DISTINCT {v}) AS distinct_count, {low} AS min_value, {high} AS max_value FROM p"


@query(f"WITH {SPARSE} " + " UNION ALL ".join(map(_profile_sql, COLUMNS)))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.column_profile(_sparse(spark, sf_dir))


@query(f"WITH {SPARSE} SELECT 'severity_level' AS column_name, severity_level AS sample FROM (SELECT DISTINCT severity_level FROM p WHERE severity_level IS NOT NULL) ORDER BY severity_level LIMIT 3")
def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_samples(_sparse(spark, sf_dir))


@query("SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_keys, (sum(n) - count(*))::BIGINT AS duplicate_rows, round(100.0 * (sum(n) - count(*)) / sum(n), 2)::DOUBLE AS duplicate_percent FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def pk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.key_audit(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT count(DISTINCT o_orderstatus) AS source_files, floor(epoch(min(o_orderdate)))::BIGINT AS first_s, floor(epoch(max(o_orderdate)))::BIGINT AS last_s, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS updated_rows FROM orders")
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("landing_source_file"), F.col("o_orderdate").alias("ingestion_timestamp"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).alias("updated_timestamp"))
    return audit.lineage_audit(o).select("source_files", epoch_s(F.col("first_ingestion")).alias("first_s"), epoch_s(F.col("last_ingestion")).alias("last_s"), "updated_rows")


INVENTORY = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in INVENTORY))
def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_counts({t: table(spark, sf_dir, t) for t in INVENTORY})


GRID = "SELECT round(36.0::DOUBLE + i * (7.5::DOUBLE / 39), 2) AS latitude, round(-9.0::DOUBLE + j * (12.5::DOUBLE / 54), 2) AS longitude FROM range(40) a(i), range(55) b(j) UNION ALL SELECT round(27.6::DOUBLE + i * ((29.4::DOUBLE - 27.6::DOUBLE) / 9), 2), round(-18.1::DOUBLE + j * ((-13.3::DOUBLE - -18.1::DOUBLE) / 29), 2) FROM range(10) a(i), range(30) b(j)"


@query(f"WITH {FIRES}, g AS ({GRID}) SELECT latitude, longitude, count(event_id) AS fires FROM g LEFT JOIN fires ON lat BETWEEN latitude - 0.1::DOUBLE AND latitude + 0.1::DOUBLE AND lon BETWEEN longitude - 0.1::DOUBLE AND longitude + 0.1::DOUBLE GROUP BY ALL")
def weather_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that forecasts are asked for, with how many fires are around each."""
    around = spatial.box_join(grid_points(spark), fires(spark, sf_dir).select("event_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), spatial.Box(0.1, 0.1), ("latitude", "longitude"), ("lat", "lon"))
    counts = around.groupBy("latitude", "longitude").agg(F.count("*").alias("fires"))
    return grid_points(spark).join(counts, ["latitude", "longitude"], "left").select("latitude", "longitude", F.coalesce("fires", F.lit(0)).alias("fires"))


@query("SELECT o_orderkey AS latitude_e3, floor(epoch(o_orderdate) / 86400)::BIGINT AS day, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS frp, o_orderstatus AS confidence, NULL::VARCHAR AS satellite FROM orders")
def csv_landing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as detections in CSV files, read with the declared columns (a number that
    isn't any is null, as is a column that the files lack) into RAW and back."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    work = shared_dir(spark, "landing")
    o.select((F.col("o_orderkey") / 1000).alias("latitude"), F.col("o_orderdate").cast("date").alias("acq_date"), text.alias("frp"), F.col("o_orderstatus").alias("confidence")).write.option("header", True).csv(f"{work}/fires/2024/01")
    files.write_raw(files.read_csv(spark, f"{work}/fires", ntz(AS_OF), files.FIRE_CSV), f"{work}/raw")
    raw = files.read_raw(spark, f"{work}/raw")
    return raw.select(F.round(F.col("latitude") * 1000).cast("long").alias("latitude_e3"), F.floor(epoch_s(F.col("acq_date")) / 86400).cast("long").alias("day"), "frp", "confidence", "satellite")


@query("SELECT c_custkey AS id, h AS hour, c_acctbal AS temperature, CASE WHEN h < 2 THEN c_nationkey END AS humidity FROM customer, range(3) r(h)")
def json_landing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as forecasts in JSON files, taken to RAW rows, then to a row an hour."""
    c = table(spark, sf_dir, "customer")
    hourly = F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda h: F.concat(F.lit("2024-01-15T0"), h, F.lit(":00"))).alias("time"), F.array_repeat("c_acctbal", 3).alias("temperature_2m"), F.array_repeat("c_nationkey", 2).alias("relative_humidity_2m"))
    work = shared_dir(spark, "landing")
    point = F.struct(F.col("c_custkey").alias("elevation"), F.lit(40.0).alias("latitude"), hourly.alias("hourly"))
    c.groupBy(F.floor(F.col("c_custkey") / 500)).agg(F.to_json(F.collect_list(point)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{work}/weather/2024")
    files.write_raw(files.read_json(spark, f"{work}/weather", ntz(AS_OF)), f"{work}/raw")
    raw = files.read_raw(spark, f"{work}/raw")
    arrays = {n: F.col(f"hourly.{n}") for n in ("time", "temperature_2m", "relative_humidity_2m")}
    hours = tables.unnest_parallel(raw, arrays, ["elevation"], index="hour", driver="time")
    return hours.select(F.col("elevation").cast("long").alias("id"), F.col("hour").cast("long").alias("hour"), F.col("temperature_2m").alias("temperature"), F.col("relative_humidity_2m").alias("humidity"))


@query(f"WITH {FIRES}, {ROADS}, {NEAR_ROADS} SELECT fire_id AS fire_detection_id, way AS osm_way_id, lanes::INT AS lanes_count, round(d, 6) AS distance_to_fire_km, NULL::VARCHAR AS road_name, '{AS_OF[:10]}' AS updated FROM m WHERE d <= 5")
def declared_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures inserted into a table of the declared columns, and read by its name."""
    name = f"emberline_q.exposure_{uuid.uuid4().hex[:8]}"
    stored = merge.VersionedTable(spark, shared_dir(spark, "exposure"), name=name)
    stored.create(FIRE_EXPOSURE)
    near = gold.fire_exposure(gold.fire_roads(fires(spark, sf_dir), roads(spark, sf_dir), gold.HIGH_KM)).where("exposure_level = 'HIGH'")
    stored.write(decision_table("gold_fire_exposure", near.withColumn("gold_updated_at", F.lit(AS_OF).cast("timestamp"))))
    out = spark.table(name)
    return out.select("fire_detection_id", "osm_way_id", "lanes_count", F.round("distance_to_fire_km", 6).alias("distance_to_fire_km"), "road_name", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT o_orderkey::VARCHAR AS record_id, o_orderpriority AS severity, o_totalprice::VARCHAR AS first_price, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    price = F.col("o_totalprice").cast("string")
    text = part('<d:feed xmlns:d="urn:d"><d:situationRecord id="', F.col("o_orderkey").cast("string"), '"><d:severity> ', F.col("o_orderpriority"), " </d:severity><d:from><d:price>", price, "</d:price></d:from><d:to><d:price>0</d:price></d:to><d:status>", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(" "), "</d:status></d:situationRecord></d:feed>")
    records = flatten_xml(table(spark, sf_dir, "orders").select(text.alias("xml")), "xml", [])
    return records.select("record_id", F.col("values")["severity"].alias("severity"), F.col("values")["price"].alias("first_price"), F.col("values")["status"].alias("status"))


@query("SELECT p_partkey::BIGINT AS id, (p_size % 3)::INT AS nodes_count, p_type AS tag_highway, CASE WHEN p_size % 2 = 0 THEN p_brand END AS tag_ref, p_size % 7 AS max_speed, 36 + (p_partkey % 751) / 100 AS latitude FROM part")
def osm_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("highway"), F.col("p_type"), F.lit("ref"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("maxspeed"), (F.col("p_size") % 7).cast("string"))
    element = F.struct(F.col("p_partkey").alias("id"), F.lit("way").alias("type"), F.expr("slice(array(1L, 2L, 3L), 1, cast(p_size % 3 as int))").alias("nodes"), tags.alias("tags"), F.array(F.struct(F.expr("36 + (p_partkey % 751) / 100").alias("lat"), F.lit(0.0).alias("lon"))).alias("geometry"))
    text = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("text"))
    rows = road_rows(text.select(F.from_json("text", ROADS_JSON)["elements"].alias("elements")))
    return rows.select("id", "nodes_count", "tag_highway", "tag_ref", F.col("tag_maxspeed").try_cast("int").alias("max_speed"), silver.first_vertex(F.col("geometry_json"))[0].alias("latitude"))


@query("SELECT r_regionkey AS region_key, r_name AS the_name FROM region")
def sanitised_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sanitise_columns(table(spark, sf_dir, "region").toDF(" region  (key)", "{the}=name;"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_replay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, merged into a table of the last one of each user."""
    return replay(spark, f"{sf_dir}/events.parquet", shared_dir(spark, "stream"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "value")


@query("SELECT floor(epoch(max(o_orderdate)))::BIGINT AS latest_s FROM orders")
def latest_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ingestion_timestamp"))
    return merge.latest_ingestion(feed).select(epoch_s(F.col("latest_ingestion")).alias("latest_s"))


CLOSURE = f"""WITH {INCIDENTS}, k AS (SELECT *, id::BIGINT AS n FROM incidents)
SELECT id AS record_id, floor(epoch(CASE WHEN e IS NOT NULL THEN e WHEN n % 5 <> 0 THEN NULL WHEN n % 3 = 1 THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-03 00:00:00' END))::BIGINT AS end_s FROM k"""


@query(CLOSURE)
def lake_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of a feed: what a day's snapshot lacks is closed, stays closed at that
    time, and opens again if a later snapshot has it."""
    number = F.col("record_id").cast("long")
    here = [number % 3 != 0, number % 3 != 1, number % 5 != 0]
    first = F.when(here[0], 0).when(here[1], 1).otherwise(2)
    rows = incidents(spark, sf_dir).withColumn("day", first).withColumns({"ingestion_timestamp": F.expr("timestamp_ntz '2024-02-01 00:00:00' + make_dt_interval(day)"), "landing_source_file": F.concat(F.lit("f"), "day")})
    loads = []
    for day in range(3):
        latest = ntz(f"2024-02-0{day + 1} 00:00:00")
        seen = rows.where(F.col("day") <= day).drop("day")
        loads.append(merge.snapshot_merge(seen, seen.where(here[day]), "record_id", latest, latest))
    return _merged(spark, loads, ["record_id"]).select("record_id", epoch_s(F.col("end_timestamp")).alias("end_s"))


@query(CLOSURE)
def stream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three days as XML documents, a few to a snapshot, read as a stream."""
    number = F.col("record_id").cast("long")
    here = [number % 3 != 0, number % 3 != 1, number % 5 != 0]
    rows = incidents(spark, sf_dir).select("record_id", "end_timestamp", F.explode(F.array_compact(F.array(*(F.when(h, F.lit(d)) for d, h in enumerate(here))))).alias("day"))
    end = F.coalesce(F.concat(F.lit("<end>"), F.date_format("end_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</end>")), F.lit(""))
    one = F.concat(F.lit('<situationRecord id="'), "record_id", F.lit('"><n>1</n>'), end, F.lit("</situationRecord>"))
    parts = rows.groupBy("day", F.floor(number / 8000).alias("part")).agg(F.array_join(F.collect_list(one), "").alias("all"))
    time = F.concat(F.lit("<feed><time>2024-02-0"), F.col("day") + 1, F.lit("T00:00:00</time>"))
    work = shared_dir(spark, "snapshots")
    parts.repartition("day", "part").select(F.concat(time, "all", F.lit("</feed>")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{work}/landing")
    published = F.try_to_timestamp(F.regexp_extract(F.col("content").cast("string"), "<time>(.*?)</time>", 1))
    documents = snapshots.document_stream(spark, f"{work}/landing", pattern="part-*")
    snapshots.snapshot_stream(documents, f"{work}/table", f"{work}/checkpoint", published).awaitTermination()
    found = snapshots.presence(spark, f"{work}/table")
    own = F.try_to_timestamp(F.col("values")["end"]).cast("timestamp_ntz")
    return found.select("record_id", epoch_s(F.coalesce(own, "gone_at")).alias("end_s"))


@query("""WITH a AS (SELECT event_id, user_id, 1 AS refresh, value FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id, user_id, 2 AS refresh, value * 2 AS value FROM events WHERE event_id % 3 = 0)
SELECT event_id::VARCHAR AS fire_detection_id, user_id::VARCHAR AS traffic_incident_id, refresh, value AS distance_km FROM b UNION ALL SELECT event_id::VARCHAR, user_id::VARCHAR, refresh, value FROM a WHERE event_id % 3 <> 0""")
def gold_traffic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes of the impact table: pairs that the second doesn't find stay."""
    e = table(spark, sf_dir, "events")
    stored = KeyedTable(spark, shared_dir(spark, "impacts"), gold.IMPACT_KEYS)
    stored.create(gold.TRAFFIC_IMPACT)
    for refresh, found in ((1, e.where("event_id % 2 = 0")), (2, e.where("event_id % 3 = 0"))):
        rows = found.select(F.col("event_id").cast("string").alias("fire_detection_id"), F.col("user_id").cast("string").alias("traffic_incident_id"), (F.col("value") * refresh).alias("distance_km"), F.expr(f"timestamp '2024-01-0{refresh} 00:00:00'").alias("gold_updated_at"), F.lit(1).alias("not_declared"))
        stored.merge(gold.traffic_impact_merge(rows))
    return stored.read().select("fire_detection_id", "traffic_incident_id", F.day("gold_updated_at").alias("refresh"), "distance_km")


@query("""SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL THEN t.status END AS status, s.price
FROM (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0) t FULL JOIN (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 1) s ON t.id = s.id""")
def merge_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge whose sides have other columns: the result has those of either."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey as id", "o_orderstatus as status")
    new = o.where("o_orderkey % 3 <> 1").selectExpr("o_orderkey as id", "o_totalprice as price")
    return _merged(spark, [merge.Merge(old, ["id"]), merge.Merge(new, ["id"])], ["id"])


@query("SELECT r_regionkey AS region_key, NULL::VARCHAR AS geometry_json, r_name FROM region")
def optional_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_key"), "r_name")
    return tables.with_optional(tables.with_optional(r, "geometry_json", "string"), "r_name", "int")


@query("SELECT * FROM (VALUES ('orders', 'o_orderdate'), ('lineitem', 'l_shipdate')) t(table_name, column_name)")
def date_like_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, c) for t in ("orders", "lineitem", "region") for c in audit.date_columns(table(spark, sf_dir, t))]
    return spark.createDataFrame(found, "table_name string, column_name string")
