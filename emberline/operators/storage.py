"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoSharedFolder(RuntimeError):
    """A cluster whose session names no folder that all executors reach."""


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share.

    spark.checkpoint.dir names that folder. Where it is unset, a folder of this machine
    is used if driver and executors are one process (local mode, as in tests); on a
    cluster each executor would write to its own disk, so NoSharedFolder is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise NoSharedFolder("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/emberline-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, *, rows_a_file: int = 250_000) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and
    lets later stages survive a lost executor. rows: how many rows of a few numbers df
    has, if known, so that a small table isn't strewn over a file for each shuffle
    partition; the last stage then has a task for each file, and for each core at least.
    See discard.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_file)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned. To be called once all that is made of them
    is stored itself; frames that still read them fail afterwards. Others are left alone."""
    for t in tables:
        if (path := getattr(t, "_stored_at", None)) is not None:
            delete_folder(t.sparkSession, path)


def placed(docs: DataFrame, file: str, row: str) -> DataFrame:
    """docs with the place at which each row is stored behind its own columns: a hash of
    its file's name and its number in that file. Unlike monotonically_increasing_id they
    don't depend on how a read cuts files into splits, so decisions made on one read hold
    for the next. What isn't a plain table of Parquet files is written to one first."""

    def add(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))

    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            return add(docs)
        except AnalysisException:  # other formats don't number their rows
            pass
    return add(written(docs, "placed"))
