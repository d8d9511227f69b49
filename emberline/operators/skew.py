"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], *, total: int, count: str = "n", how: str = "left") -> DataFrame:
    """rows joined to a table of unique keys, without `count`, the table's column that says
    how many rows have the key; total: the sum of it. how: left or inner.

    A key of more than a quarter of a mean partition's rows is hot. There are fewer than
    four such keys a partition, whatever the size of the data, so these are broadcast and
    their rows stay where they are; the others are shuffled, so no task gets a hot key.
    rows and table are read twice: give stored ones. Keys must not be null.
    """
    spark = rows.sparkSession
    hot = F.col(count) > max(total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    few, many = table.where(hot).drop(count), table.where(~hot).drop(count)
    met = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys, how)
    return met.unionByName(rest.select(*(F.col(f"`{c}`") for c in met.columns)))
