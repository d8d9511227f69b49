"""Helpers for operators that run on DataFrame and SQL functions alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's values, made by JVM expressions."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schema.split(','))}>>")))


def signed(x: int) -> int:
    """An unsigned 64-bit value as the signed one of the same bits."""
    return x - (1 << 64) if x >= 1 << 63 else x
