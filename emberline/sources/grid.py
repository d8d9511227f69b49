"""The points that forecasts are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (south, north, rows, west, east, columns) of the mainland and the islands.
WEATHER_GRIDS = [(36.0, 43.5, 40, -9.0, 3.5, 55), (27.6, 29.4, 10, -18.1, -13.3, 30)]


def weather_grid(spark: SparkSession, grids: list[tuple] = WEATHER_GRIDS) -> DataFrame:
    """(latitude, longitude) of evenly spaced points, to two decimals."""
    out = None
    for south, north, rows, west, east, columns in grids:
        at = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
        points = at.select(F.round(F.lit(south) + F.col("i") * F.lit((north - south) / (rows - 1)), 2).alias("latitude"), F.round(F.lit(west) + F.col("j") * F.lit((east - west) / (columns - 1)), 2).alias("longitude"))
        out = points if out is None else out.unionByName(points)
    return out
