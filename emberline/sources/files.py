"""Scans of landing files into RAW rows with lineage, and the RAW sink.

Paths are URIs as Spark takes them; none is rewritten for a particular lake's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRE_CSV = "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date date, acq_time int, satellite string, confidence string, version string, bright_ti5 double, frp double, daynight string"
WEATHER_JSON = "latitude double, longitude double, elevation double, timezone string, hourly struct<time: array<string>, temperature_2m: array<double>, relative_humidity_2m: array<int>, precipitation: array<double>, wind_speed_10m: array<double>>"
ROADS_JSON = "elements array<struct<id: bigint, type: string, nodes: array<bigint>, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"
#: Road tags that become columns.
ROAD_TAGS = ["highway", "ref", "name", "maxspeed", "lanes", "oneway", "surface", "bridge", "tunnel"]


def with_lineage(df: DataFrame, now: Column) -> DataFrame:
    """df with the file that each row comes from and the time of ingestion."""
    return df.select("*", F.col("_metadata.file_name").alias("landing_source_file"), F.col("_metadata.file_path").alias("landing_source_path"), now.cast("timestamp_ntz").alias("ingestion_timestamp"))


def read_json(spark: SparkSession, path: str | list[str], now: Column, schema: str | T.StructType = WEATHER_JSON, *, error: str | None = None) -> DataFrame:
    """Rows of all JSON files below path, each an object or a list of objects. error: a
    column of that name says what of a file isn't JSON, null for its rows."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if error:
        wanted = T.StructType([*wanted.fields, T.StructField(error, T.StringType())])
    reader = spark.read.schema(wanted).option("multiLine", True).option("recursiveFileLookup", True)
    rows = with_lineage((reader.option("columnNameOfCorruptRecord", error) if error else reader).json(path), now)
    if not error:
        return rows
    read = F.when(F.col(f"`{wanted.names[0]}`").isNull(), F.lit("nothing")).otherwise(F.lit("a part"))
    return rows.withColumn(error, F.when(F.col(error).isNotNull(), F.concat(F.lit("not JSON, "), read, F.lit(" of it is read"))))


def read_csv(spark: SparkSession, path: str | list[str], now: Column, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of all CSV files below path, columns by the header's names. Without a schema the
    types are inferred, at the price of a second pass."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    if schema is None:
        return with_lineage(reader.option("inferSchema", True).csv(path), now)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = with_lineage(reader.csv(path), now)
    cols = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return raw.select(*cols, "landing_source_file", "landing_source_path", "ingestion_timestamp")


def read_raw(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet dataset, None if it isn't there or has no rows."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def write_raw(df: DataFrame, path: str, *, append: bool = False) -> None:
    """Near-real-time feeds append; batch feeds and snapshots overwrite."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def latest_file(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    """The path of the file below path that was changed last, by name among equals."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def road_rows(elements: DataFrame) -> DataFrame:
    """One row for each road of rows (elements, ...): counts, tags as columns (empty ones
    null) and the geometry as JSON text. Other columns stay."""
    rest = [c for c in elements.columns if c != "elements"]
    e = elements.select(*rest, F.explode("elements").alias("e"))
    tag = lambda t: F.nullif(F.col("e.tags")[t], F.lit("")).alias(f"tag_{t}")
    return e.select(F.col("e.id").alias("id"), F.nullif(F.col("e.type"), F.lit("")).alias("type"), F.coalesce(F.size("e.nodes"), F.lit(0)).alias("nodes_count"), *map(tag, ROAD_TAGS), F.to_json("e.geometry").alias("geometry_json"), *rest).withColumn("nodes_count", F.greatest("nodes_count", F.lit(0)))


def read_roads(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Roads of a JSON file, or of the newest one in a folder."""
    newest = latest_file(spark, path, "*.json")
    return road_rows(read_json(spark, newest or path, now, ROADS_JSON))
