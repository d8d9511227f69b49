"""A session with the settings that the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Event times are wall-clock values without a zone; sessions run in UTC so that sources in
#: different zones are converted once, on reading.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "emberline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
