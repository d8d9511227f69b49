"""The ledger of landing files: which have been read, when, and what came of them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable
from ..operators.merge import Merge

SCHEMA = "path string, source string, length long, modified timestamp, snapshot timestamp_ntz, rows long, error string"


@dataclass(frozen=True)
class Arrived:
    """Files of one run and the snapshot time of each: the run's time, a microsecond later
    for each file that was changed after another (by path among equals), and always after
    all earlier snapshots."""

    files: DataFrame
    paths: list[str]

    def stamped(self, rows: DataFrame) -> DataFrame:
        """RAW rows with their file's snapshot time as that of their ingestion."""
        times = self.files.select(F.col("path").alias("landing_source_path"), F.col("snapshot").alias("ingestion_timestamp"))
        return rows.drop("ingestion_timestamp").join(F.broadcast(times), "landing_source_path").select(*(c for c in rows.columns))  # a row for each new file


class FileLedger:
    """A keyed table with a row for each file, rewritten when the file changes: so a file
    without rows, or one that can't be read, isn't read at each run, and RAW isn't scanned
    to find out what is new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, KeyedTable(spark, path, ["path"], buckets=4)
        self.table.create(SCHEMA)

    def read(self) -> DataFrame:
        return self.table.read()

    def arrived(self, source: str, landing: str, pattern: str, now: datetime, *, newest_only: bool = False) -> Arrived | None:
        """The files below landing that the ledger lacks, or has with another length or time
        of change; None if there are none. newest_only: the one that was changed last, if new."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(landing)
        meta = listed.metadataColumn("_metadata")
        files = listed.select(meta["file_path"].alias("path"), "length", F.col("modificationTime").alias("modified"))
        if newest_only:
            files = files.orderBy(F.desc("modified"), F.desc("path")).limit(1)
        known = self.read().where(F.col("source") == source)
        new = files.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti").collect()  # a run's new files
        if not new:
            return None
        last = known.agg(F.max("snapshot")).first()[0]
        start = now if last is None or now > last else last + timedelta(microseconds=1)
        rows = [(r.path, source, r.length, r.modified, start + timedelta(microseconds=k)) for k, r in enumerate(sorted(new, key=lambda r: (r.modified, r.path)))]
        found = self.spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5]))
        return Arrived(found, [r[0] for r in rows])

    def note(self, arrived: Arrived, rows: DataFrame) -> list[str]:
        """Enters a run's files with how many of the rows (landing_source_path, error) each
        gave; rows with an error count for none. The errors, by path."""
        seen = rows.groupBy(F.col("landing_source_path").alias("path")).agg(F.count_if(F.col("error").isNull()).alias("rows"), F.max("error").alias("error"))
        noted = arrived.files.join(seen, "path", "left").select(*arrived.files.columns, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "error")
        self.table.merge(Merge(noted, ["path"]))
        return [f"{r.path}: {r.error}" for r in self.read().join(arrived.files.select("path"), "path").where("error is not null").orderBy("path").collect()]

    def snapshots(self, source: str) -> DataFrame:
        """(snapshot, next): the times of a source's readable files, and the one after each."""
        times = self.read().where((F.col("source") == source) & F.col("error").isNull()).select("snapshot")
        return times.withColumn("next", F.lead("snapshot").over(Window.orderBy("snapshot")))  # a row for each file
