"""Typed, deduplicated tables from the sources' raw columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_region
from ..functions.temporal import detection_time
from ..operators.spatial import assign_clusters, cluster_summary
from ..operators.tables import latest_per_key, union_by_name, unnest_parallel, with_optional

LINEAGE = ["landing_source_file", "ingestion_timestamp"]
KEYS = {"bronze_weather": ["latitude", "longitude"], "bronze_traffic": ["record_id"], "bronze_fires_nrt": ["latitude", "longitude", "acq_date", "acq_time"], "bronze_fires_hist": ["latitude", "longitude", "acq_date", "acq_time"], "bronze_roads": ["id"], "silver_weather": ["latitude", "longitude", "forecast_timestamp"], "silver_fires": ["latitude", "longitude", "acq_date", "acq_time"], "silver_traffic": ["record_id"], "silver_roads": ["osm_way_id"]}


def fire_id(lat: str = "latitude", lon: str = "longitude", ts: str = "fire_detection_timestamp") -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (lat, lon, ts))), 256)


def weather(bronze: DataFrame) -> DataFrame:
    """One row for each point and hour; points outside the region and hours that aren't
    times go."""
    keep = ["latitude", "longitude", "elevation", "timezone", *LINEAGE]
    arrays = {"time": F.col("hourly.time"), **{n: F.col(f"hourly.{n}") for n in ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")}}
    hours = unnest_parallel(in_region(bronze), arrays, keep, driver="time")
    at = F.coalesce(F.try_to_timestamp(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(F.col("time")))
    out = hours.select("latitude", "longitude", "elevation", "timezone", F.to_utc_timestamp(at, F.coalesce("timezone", F.lit("UTC"))).alias("forecast_timestamp"), F.col("temperature_2m").cast("double").alias("temperature_celsius"), F.col("relative_humidity_2m").cast("int").alias("humidity_percentage"), F.col("precipitation").cast("double").alias("precipitation_mm"), F.col("wind_speed_10m").cast("double").alias("wind_speed_kmh"), *LINEAGE)
    return latest_per_key(out.where("forecast_timestamp is not null"), KEYS["silver_weather"])


def detections(*bronze: DataFrame) -> DataFrame:
    """Detections of all feeds in the region, the last ingested of each place and time,
    with their fire_id."""
    rows = in_region(union_by_name(*bronze))
    at = detection_time(F.col("acq_date"), F.col("acq_time"))
    out = rows.select("latitude", "longitude", F.col("acq_date").cast("date").alias("acq_date"), F.col("acq_time").cast("int").alias("acq_time"), at.alias("fire_detection_timestamp"), "bright_ti4", "bright_ti5", F.col("frp").cast("double").alias("fire_radiative_power"), "confidence", "daynight", *LINEAGE)
    latest = latest_per_key(out, KEYS["silver_fires"]).where("fire_detection_timestamp is not null")
    return latest.withColumn("fire_id", fire_id())


def fires(*bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fires with cluster_id, clusters)."""
    from ..operators.storage import written

    found = written(detections(*bronze), "detections")
    clustered = written(found.join(assign_clusters(found), "fire_id", "left"), "fires")
    return clustered, cluster_summary(clustered)


def detail_type(*tags: Column) -> Column:
    return F.coalesce(*tags, F.lit("unknown"))


def traffic(records: DataFrame) -> DataFrame:
    """Incidents from (record_id, values, lineage): tags that a record lacks are null, and
    records without an id or a place in the region go."""
    v = lambda t: F.col("values")[t]
    time = lambda t: F.try_to_timestamp(v(t)).cast("timestamp_ntz")
    out = records.select(
        "record_id", v("roadName").alias("road_name"), v("province").alias("province"), v("autonomousCommunity").alias("autonomous_community"), v("municipality").alias("municipality"),
        v("latitude").try_cast("double").alias("latitude"), v("longitude").try_cast("double").alias("longitude"), v("kilometerPoint").try_cast("double").alias("kilometer_point"), v("causeType").alias("cause_type"),
        detail_type(v("roadMaintenanceType"), v("vehicleObstructionType"), v("environmentalObstructionType")).alias("incident_detail_type"), F.coalesce(v("severity"), F.lit("normal")).alias("severity_level"),
        time("overallStartTime").alias("start_timestamp"), time("overallEndTime").alias("end_timestamp"), v("carriageway").alias("carriageway"), v("laneUsage").alias("lane_usage"), v("vehicleType").alias("vehicle_type"), *LINEAGE,
    )
    return latest_per_key(in_region(out.where("record_id is not null")), KEYS["silver_traffic"])


def first_vertex(geometry: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the first point of a geometry in JSON text."""
    return tuple(F.get_json_object(geometry, f"$[0].{c}").try_cast("double") for c in ("lat", "lon"))


def roads(bronze: DataFrame) -> DataFrame:
    """Roads with typed tags; numbers that aren't any ("50 mph") are null. The centroid
    columns hold the first vertex."""
    rows = with_optional(bronze, "geometry_json", "string")
    lat, lon = first_vertex(F.col("geometry_json"))
    out = rows.select(
        F.col("id").cast("string").alias("osm_way_id"), "nodes_count", F.col("tag_highway").alias("road_classification"), F.col("tag_ref").alias("road_reference"), F.col("tag_name").alias("road_name"),
        F.col("tag_maxspeed").try_cast("int").alias("max_speed_kmh"), F.col("tag_lanes").try_cast("int").alias("lanes_count"), F.col("tag_oneway").alias("is_oneway"), F.col("tag_surface").alias("pavement_surface"),
        F.col("tag_bridge").alias("has_bridge"), F.col("tag_tunnel").alias("has_tunnel"), lat.alias("centroid_latitude"), lon.alias("centroid_longitude"), F.col("geometry_json").alias("road_geometry"), *LINEAGE,
    )
    return latest_per_key(out.where("osm_way_id is not null"), KEYS["silver_roads"])
