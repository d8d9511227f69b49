"""The declared columns of the decision tables, and what their rows call them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.declared import as_declared
from ..operators.tables import with_optional

#: The declared columns of the decision tables that each refresh makes anew.
FIRE_RISK = (
    "fire_id string, cluster_id string, fire_detection_timestamp timestamp, fire_latitude double, fire_longitude double, forecast_timestamp timestamp, weather_latitude double, weather_longitude double, "
    "weather_distance_km double, temperature_2m double, relative_humidity_2m double, precipitation double, wind_speed_10m double, brightness double, frp double, temperature_score int, humidity_score int, "
    "wind_score int, precipitation_score int, fire_intensity_score int, fire_risk_score int, fire_risk_level string, source_fire string, source_weather string, updated_at timestamp"
)
FIRE_EVOLUTION = (
    "fire_id string, cluster_id string, latitude double, longitude double, acq_date date, acq_time int, fire_detection_timestamp timestamp, bright_ti4 double, bright_ti5 double, fire_radiative_power double, "
    "previous_frp double, frp_change_mw double, evolution_trend string, confidence string, daynight string, detection_date date, detection_hour int, detection_minute int, detection_year int, detection_month int, "
    "detection_day int, fire_intensity_level string, fire_intensity_score int, cluster_first_detection_timestamp timestamp, cluster_last_detection_timestamp timestamp, cluster_detection_count bigint, "
    "cluster_centroid_latitude double, cluster_centroid_longitude double, cluster_max_frp double, cluster_avg_frp double, landing_source_file string, ingestion_timestamp timestamp, updated_source_file string, "
    "updated_timestamp timestamp, gold_updated_at timestamp"
)
_ROAD = (
    "fire_detection_id string, cluster_id string, fire_detection_timestamp timestamp, fire_latitude double, fire_longitude double, fire_radiative_power double, osm_way_id string, road_reference string, "
    "road_name string, road_classification string, road_latitude double, road_longitude double, {} double, max_speed_kmh int, lanes_count int, is_oneway string, pavement_surface string, has_bridge string, has_tunnel string, "
)
FIRE_ROAD_IMPACT = _ROAD.format("distance_fire_road_km") + "traffic_incident_count bigint, active_traffic_incident_count bigint, max_traffic_severity string, road_impact_level string, fire_source_file string, osm_source_file string, gold_updated_at timestamp"
FIRE_EXPOSURE = _ROAD.format("distance_to_fire_km") + "exposure_level string, source_fire string, source_osm string, updated_at timestamp"
EVACUATION_ROUTES = _ROAD.format("distance_to_fire_km") + "active_traffic_incident_count bigint, traffic_severity string, distance_score int, capacity_score int, traffic_score int, road_type_score int, evacuation_suitability_score int, evacuation_category string, source_fire string, source_osm string, updated_at timestamp"

TABLES = {"gold_fire_risk": FIRE_RISK, "gold_fire_evolution": FIRE_EVOLUTION, "gold_fire_road_impact": FIRE_ROAD_IMPACT, "gold_fire_exposure": FIRE_EXPOSURE, "gold_evacuation_routes": EVACUATION_ROUTES}

_SOURCES = {"source_fire": "fire_source_file", "source_osm": "osm_source_file", "source_weather": "weather_source_file", "updated_at": "gold_updated_at"}
_WEATHER = {"temperature_2m": "temperature_celsius", "relative_humidity_2m": "humidity_percentage", "precipitation": "precipitation_mm", "wind_speed_10m": "wind_speed_kmh"}
NAMED = {n: dict(_SOURCES) for n in TABLES} | {"gold_fire_risk": {**_SOURCES, **_WEATHER, "fire_id": "fire_detection_id", "brightness": "fire_brightness_ti4", "frp": "fire_radiative_power"}}

#: Columns that only some feeds bring; null where they don't.
_OPTIONAL = {
    "fire_source_file": "string", "osm_source_file": "string", "weather_source_file": "string", "landing_source_file": "string", "ingestion_timestamp": "timestamp", "updated_source_file": "string", "updated_timestamp": "timestamp",
    "road_reference": "string", "road_name": "string", "max_speed_kmh": "int", "is_oneway": "string", "pavement_surface": "string", "has_bridge": "string", "has_tunnel": "string",
    "bright_ti4": "double", "bright_ti5": "double", "fire_brightness_ti4": "double", "acq_date": "date", "acq_time": "int", "confidence": "string", "daynight": "string",
}


def decision_table(name: str, rows: DataFrame) -> DataFrame:
    """Rows of a decision table as it is declared; WrongColumns if they can't be."""
    for column, kind in _OPTIONAL.items():
        rows = with_optional(rows, column, kind)
    return as_declared(rows, TABLES[name], NAMED[name])
