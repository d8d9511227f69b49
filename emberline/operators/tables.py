"""Rows by key: the latest, the nearest, the previous one; unions; column names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value that can be compared and hashed: maps, wherever in it, as entries in order."""
    if not _has_map(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(comparable(value[f.name], f.dataType).alias(f.name) for f in kind)))
    entry = lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(value), entry))


def free_names(df: DataFrame | list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df (or of a list of names) has."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def _first_of(df: DataFrame, window) -> DataFrame:
    (rank,) = free_names(df, "rank")
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(f"`{rank}`") == 1).drop(rank)


def latest_per_key(df: DataFrame, keys: list[str], order: str | Column = "ingestion_timestamp", ties: list[str | Column] | None = None) -> DataFrame:
    """One row of each key: the last by `order`, nulls last, then by `ties` (without them
    by all other columns, so that the choice doesn't depend on the rows' places)."""
    rest = ties if ties is not None else [F.xxhash64(*(comparable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name not in keys)).asc()] if set(df.columns) - set(keys) else []
    first = F.col(order) if isinstance(order, str) else order
    window = Window.partitionBy(*keys).orderBy(first.desc_nulls_last(), *rest)
    return _first_of(df, window)


def nearest_per_key(df: DataFrame, keys: list[str], distance: str, ties: list[str | Column]) -> DataFrame:
    """One row of each key: the nearest, distances taken to a millimetre, then by ties."""
    window = Window.partitionBy(*keys).orderBy(F.round(distance, 6).asc(), *ties)
    return _first_of(df, window)


#: A group of so many rows at most goes to one task.
FEW_ROWS = 10_000


def with_previous(df: DataFrame, value: str, by: str, order: list[str], name: str) -> DataFrame:
    """df with a column `name`: the value of the row before, in `order`, of the same `by`;
    null for the first and where that is null. Rows of a null `by` are one group.

    Groups of over a quarter of a mean partition's rows, of which there are fewer than four
    a partition, are dealt by ranges of (by, order); a range begins with the last value of
    the one before, so no task has all rows of a group. Others go through a window."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.col(by).alias("by_")).agg(F.count("*").alias("n"))
    total = df.count()
    large = counts.where(F.col("n") > max(total // (4 * tasks), FEW_ROWS)).select("by_")
    if large.isEmpty():
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    same = F.col(by).eqNullSafe(F.col("by_"))
    few = F.broadcast(large)
    rest = df.join(few, same, "left_anti").withColumn(name, F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    (part,) = free_names([*df.columns, name], "part")
    hot = df.join(few, same, "left_semi").repartitionByRange(tasks, by, *order)
    hot = written(hot.withColumn(part, F.spark_partition_id()), "ranges")
    rank = F.struct(*order)
    ends = hot.groupBy(by, part).agg(F.max_by(F.struct(F.col(value).alias("v")), rank).alias("last"))
    before = ends.select(by, part, F.lag("last").over(Window.partitionBy(by).orderBy(part)).alias("before"))  # a row a range and group
    own = Window.partitionBy(by, part).orderBy(*order)
    at, back = free_names([*df.columns, name, part], "at", "back")
    carried = F.broadcast(before.where("before is not null").select(F.col(by).alias("by_"), F.col(part).alias("part_"), F.col("before.v").alias(back)))
    met = hot.withColumns({at: F.row_number().over(own), name: F.lag(value).over(own)}).join(carried, same & (F.col(part) == F.col("part_")), "left")
    out = met.withColumn(name, F.when(F.col(at) == 1, F.col(back)).otherwise(F.col(name)))
    return rest.unionByName(out.select(*(F.col(f"`{c}`") for c in rest.columns)))


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def clean_name(name: str) -> str:
    """A column name without {}:;()=/\\ and white space: runs of them become one _, none
    at either end."""
    return re.sub(r"_+", "_", re.sub(r"[{}:;()\s=/\\]", "_", name)).strip("_")


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(clean_name, df.columns))


def with_optional(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with the column, a typed null where it is missing."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def unnest_parallel(df: DataFrame, arrays: dict[str, Column], keep: list[str], *, index: str = "_pos", driver: str) -> DataFrame:
    """A row for each position of the array named `driver`, with the values of all arrays
    there; shorter ones give null, rows without a driver array vanish."""
    others = [n for n in arrays if n != driver]
    held = dict(zip(arrays, free_names([*keep, index, *arrays], *arrays), strict=True))
    base = df.select(*keep, *(a.alias(held[n]) for n, a in arrays.items()))
    out = base.select(*keep, *(held[n] for n in others), F.posexplode(held[driver]).alias(index, driver))
    return out.select(*keep, index, driver, *(F.get(F.col(held[n]), F.col(index)).alias(n) for n in others))


#: So many rows of a few numbers are few enough to be sent to all tasks.
FEW_ROWS = 1_000_000
#: As many bitmaps, of 4 KB and up to 32,768 rows of a file each.
FEW_BITMAPS = 16_384


def at_places(rows: DataFrame, places: DataFrame, file: str, row: str, *, keep: bool) -> DataFrame:
    """The rows (see placed) that are among the places, or with keep=False those that
    aren't; places are plain numbers. The places are sent to the rows as bitmaps, a bit for
    each row of a file, so rows with long texts aren't shuffled however many places there
    are: a megabyte tells of 8 million rows."""
    bucket, bits = free_names(rows, "bucket", "bits")
    marks = places.groupBy(file, F.bitmap_bucket_number(row).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias(bits))
    marks = written(marks, "places")
    if marks.count() > FEW_BITMAPS:  # files of a few rows each
        return rows.join(places.select(file, row), [file, row], "left_semi" if keep else "left_anti")
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    met = rows.withColumn(bucket, F.bitmap_bucket_number(row)).join(F.broadcast(marks), [file, bucket], "left")
    return met.where(hit if keep else ~hit).select(*(F.col(f"`{c}`") for c in rows.columns))
