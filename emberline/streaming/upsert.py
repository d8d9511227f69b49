"""A stream of landing files merged into a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable
from ..operators.merge import Merge


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: Column):
    """Starts a query that merges each batch into the table at path: a key's row is the one
    of the greatest `version` (a column that orders a key's rows), whatever order the rows
    arrive in, so late and repeated ones change nothing. Runs until all files that are
    there have been read; a later start goes on with new files only. A batch reads the table's
    buckets that its keys are in and writes the rows that it changes."""
    if "_version" in stream.columns:
        raise ValueError("the table keeps a row's version in a column _version, which the stream has itself")
    table = KeyedTable(stream.sparkSession, path, keys)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.dropna(subset=keys)
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r"), F.max(version).alias("_version")).select("r.*", "_version")
        table.merge(Merge(latest, keys, update_when=lambda o, n: n("_version") > o("_version"), check=False))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, source: str, work: str, keys: list[str], version: Column) -> DataFrame:
    """All Parquet files at source as a stream, merged; the resulting table."""
    schema = spark.read.parquet(source).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    alone = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    folder, names = (path.getParent().toString(), path.getName()) if alone else (source, "*.parquet")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", 1000).parquet(folder)
    query = merge_stream(stream, f"{work}/table", f"{work}/checkpoint", keys, version)
    query.awaitTermination()
    found = KeyedTable(spark, f"{work}/table", keys).read()
    return (found if found is not None else spark.createDataFrame([], schema)).drop("_version")
