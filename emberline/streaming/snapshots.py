"""A feed of snapshots as a stream of its files: what a later snapshot lacks has ended.

Two keyed tables hold all that closures depend on: the last record of each key with the
time of the snapshot that had it, and the times of all snapshots. Both merge by the feed's
own times, so files may arrive in any order and more than once, and a batch that is run
again changes nothing. When a record ended follows from the two: at the first snapshot
after the last one that had it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable
from ..operators.merge import Merge
from ..operators.skew import lookup
from ..operators.storage import discard, written
from ..sources.xml import flatten_xml

KEY, TIME = "record_id", "snapshot"


def _tables(spark: SparkSession, path: str) -> tuple[KeyedTable, KeyedTable]:
    return KeyedTable(spark, f"{path}/records", [KEY]), KeyedTable(spark, f"{path}/snapshots", [TIME], buckets=4)


def snapshot_stream(documents: DataFrame, path: str, checkpoint: str, published: Column):
    """Starts a query over a stream of XML documents (path, content; see the binaryFile
    source) into the tables below path. published: when a document's snapshot was taken, an
    expression on `content`; several documents may be parts of one snapshot. Those that
    don't parse or have no such time are left out whole. Runs until all files that are
    there have been read."""
    spark = documents.sparkSession
    records, snapshots = _tables(spark, path)

    def merge(batch: DataFrame, _: int) -> None:
        parts = batch.select("content", published.cast("timestamp_ntz").alias(TIME)).where(F.col(TIME).isNotNull())
        rows = written(flatten_xml(parts, "content", [TIME], error="error"), "stream_rows")
        broken = [r[0] for r in rows.where("error is not null").select(F.col(TIME).cast("string")).distinct().collect()]  # at most one for each of a batch's files
        whole = ~F.col(TIME).cast("string").isin(broken)  # a list, as even an empty broadcast takes the driver a page of memory in each batch
        times = written(parts.select(TIME).distinct().where(whole), "stream_times")
        whole = rows.where("error is null and record_id is not null").where(whole)
        latest = whole.groupBy(KEY).agg(F.max_by("values", TIME).alias("values"), F.max(TIME).alias(TIME))
        newer = lambda o, n: n(TIME) > o(TIME)
        records.merge(Merge(latest, [KEY], update_when=newer, check=False))
        snapshots.merge(Merge(times, [TIME], update=None, check=False))
        discard(rows, times)

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def presence(spark: SparkSession, path: str) -> DataFrame | None:
    """(record_id, values, snapshot, gone_at): the last record of each key, the snapshot that
    had it, and the next one, null if that was the last. None before the first batch."""
    records, snapshots = (t.read() for t in _tables(spark, path))
    if records is None or snapshots is None:
        return None
    order = snapshots.select(TIME, F.lead(TIME).over(Window.orderBy(TIME)).alias("gone_at"))  # a row for each snapshot
    counted = order.join(records.groupBy(TIME).count(), TIME)
    total = records.count()
    return lookup(records, counted, [TIME], total=total, count="count", how="inner").select(KEY, "values", TIME, "gone_at")


def document_stream(spark: SparkSession, landing: str, files_a_batch: int = 1000, pattern: str = "*.xml") -> DataFrame:
    """A stream of the files below landing whose names fit the pattern, (path, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", files_a_batch).load(landing).select("path", "content")
