"""Data-quality profiles, in one or two passes over a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import comparable

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATE_WORDS = ("date", "time", "timestamp", "creation", "generation")


def _missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]], label: str = "column_name") -> DataFrame:
    """One row for each column from one aggregation over all of them."""
    flat = [v.alias(f"{i}_{k}") for i, own in enumerate(aggregates.values()) for k, v in own.items()]
    rows = [F.struct(F.lit(name).alias(label), *(F.col(f"{i}_{k}").alias(k) for k in own)) for i, (name, own) in enumerate(aggregates.items())]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def completeness(df: DataFrame) -> DataFrame:
    """(column_name, completeness): percent of rows with a value, to two places; null for
    an empty table."""
    n = F.count(F.lit(1))
    return _long(df, {f.name: {"completeness": F.round(F.when(n > 0, 100.0 * F.count(F.col(f"`{f.name}`")) / n), 2)} for f in df.schema})


#: Distinct values that a task keeps of all columns before it passes them on.
KEPT_VALUES = 200_000


def _distinct_in_tasks(values: DataFrame) -> DataFrame:
    """(column, hash): of rows with a hash of each column's value (h, null for none), the
    distinct ones of each task. Each column has a set of its own, emptied when all together
    are full, so a column of few values passes on few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(seen), dtype="i4"), [len(s) for s in seen])), pa.array(np.concatenate(seen))], names=["column", "hash"])
        for batch in batches:
            hashes = batch.column(0)
            width = hashes.type.list_size if pa.types.is_fixed_size_list(hashes.type) else len(hashes[0]) if len(hashes) else 0
            if not width:
                continue
            flat, known = hashes.flatten(), np.asarray(hashes.flatten().is_valid()).reshape(-1, width)
            grid = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width)
            seen = seen or [np.zeros(0, "i8")] * width
            seen = [np.union1d(s, grid[known[:, c], c]) for c, s in enumerate(seen)]
            if sum(map(len, seen)) > KEPT_VALUES:
                yield made()
                seen = [np.zeros(0, "i8")] * width
        if seen:
            yield made()

    return values.mapInArrow(run, "column int, hash long")


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, null_count, null_percent, distinct_count, min_value, max_value).
    NaN counts as null. Least and greatest values, as text, of numbers, dates and times;
    for samples of the others see value_samples. Values are told apart by 64-bit hashes.

    Two passes: one aggregation for all but the distinct values; for these a set of hashes
    for each column in each task, whose (column, hash) rows alone are shuffled. No row is
    copied for each column, as exact distinct counts of many columns in one aggregation do."""
    n = F.count(F.lit(1))
    out, hashes = {}, []
    for f in df.schema:
        c, none = F.col(f"`{f.name}`"), _missing(f)
        value = F.when(~none, c)
        ranged = isinstance(f.dataType, (*NUMBERS, T.DateType, T.TimestampType, T.TimestampNTZType))
        text = lambda x, ranged=ranged: (x if ranged else F.lit(None)).cast("string")
        out[f.name] = {"null_count": F.sum(none.cast("long")), "null_percent": F.round(100.0 * F.sum(none.cast("long")) / n, 2), "min_value": text(F.min(value)), "max_value": text(F.max(value))}
        zero = (lambda x: x + F.lit(0.0).cast(f.dataType)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else (lambda x: x)  # noqa: E731, B023
        hashes.append(F.when(~none, F.xxhash64(comparable(zero(c), f.dataType))))
    kinds = _distinct_in_tasks(df.select(F.array(*hashes).alias("h"))).distinct().groupBy("column").agg(F.count("*").alias("distinct_count"))
    names = F.element_at(F.array(*map(F.lit, df.columns)), F.col("column") + 1)
    counted = kinds.select(names.alias("column_name"), "distinct_count")
    met = _long(df, out).join(F.broadcast(counted), "column_name", "left")  # a row for each column
    return met.select("column_name", "null_count", "null_percent", F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"), "min_value", "max_value")


def value_samples(df: DataFrame, most_samples: int = 3, few: int = 5) -> DataFrame:
    """(column_name, sample): the first values in order of columns with at most `few`
    distinct ones. Two passes: sketches of a fixed size tell the columns that could have so
    few, and only those columns' values are gathered, a set of a few in each task."""
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    roughly = df.agg(*(F.approx_count_distinct(v).alias(str(i)) for i, v in enumerate(text.values()))).first()
    known = [c for c, n in zip(text, roughly, strict=True) if 0 < n <= 4 * few]
    if not known:
        return df.sparkSession.createDataFrame([], "column_name string, sample string")
    sets = _long(df, {c: {"s": F.collect_set(text[c])} for c in known})
    return sets.where(F.size("s") <= few).select("column_name", F.explode(F.slice(F.sort_array("s"), 1, most_samples)).alias("sample"))


def key_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """(total_rows, distinct_keys, duplicate_rows, duplicate_percent), one row."""
    n, kinds = F.sum("n"), F.count(F.lit(1))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(n, F.lit(0)).alias("total_rows"), kinds.alias("distinct_keys")).select("*", (F.col("total_rows") - F.col("distinct_keys")).alias("duplicate_rows"), F.round(F.when(F.col("total_rows") > 0, 100.0 * (F.col("total_rows") - F.col("distinct_keys")) / F.col("total_rows")), 2).alias("duplicate_percent"))


def lineage_audit(df: DataFrame) -> DataFrame:
    """(source_files, first_ingestion, last_ingestion, updated_rows), one row."""
    return df.agg(F.countDistinct("landing_source_file").alias("source_files"), F.min("ingestion_timestamp").alias("first_ingestion"), F.max("ingestion_timestamp").alias("last_ingestion"), F.count("updated_timestamp").alias("updated_rows"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = row if out is None else out.unionByName(row)
    return out


def date_columns(df: DataFrame) -> list[str]:
    """Columns whose names sound like dates or times."""
    return [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]


def audit_sample(df: DataFrame, rows: int = 3, values: int = 3) -> DataFrame:
    """The first rows with the first value columns and the lineage."""
    lineage = [c for c in df.columns if c in ("landing_source_file", "ingestion_timestamp", "updated_source_file", "updated_timestamp")]
    return df.select(*[c for c in df.columns if c not in lineage][:values], *lineage).limit(rows)
