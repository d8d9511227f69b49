"""Flat records from nested XML, on the executors."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that are records.
RECORD_TAGS = ("situationRecord", "situationRecordExtension")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def fault_of(content: bytes) -> str | None:
    """Why a document doesn't parse, None if it does; nothing of it is kept meanwhile."""
    try:
        expat.ParserCreate(namespace_separator="}").Parse(content, True)
    except expat.ExpatError as e:
        return str(e)
    return None


def records_of(content: bytes) -> Iterator[tuple[str | None, dict[str, str]]]:
    """(id, values) of each record element in order: by local name, the first text in
    document order that isn't blank. Records without any value are left out, and so are
    files that don't parse. What has been read is dropped as soon as no open record needs
    it, so no tree of the whole document is built."""
    if fault_of(content) is not None:
        return
    opened: list[ET.Element] = []
    outer = 0  # how many records are open
    is_record = lambda e: isinstance(e.tag, str) and _local(e.tag) in RECORD_TAGS
    for event, element in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            opened.append(element)
            outer += is_record(element)
            continue
        opened.pop()
        outer -= is_record(element)
        if outer:
            continue
        if is_record(element):
            for record in filter(is_record, element.iter()):
                values: dict[str, str] = {}
                for part in record.iter():
                    if isinstance(part.tag, str) and (text := (part.text or "").strip()):
                        values.setdefault(_local(part.tag), text)
                if values:
                    yield record.attrib.get("id"), values
        if opened:
            opened[-1].remove(element)


def flatten_xml(df: DataFrame, content: str, keep: list[str], *, error: str | None = None, rows_a_batch: int = 1000) -> DataFrame:
    """(record_id, values, *keep) from a column of XML documents, binary or text; values is
    a map from local names. A null document has no records. error: a column of that name
    is null, but for one row without a record for each document that doesn't parse."""
    at = df.select(F.col(content).cast("binary").alias("content"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [pa.field(k, batch.schema.field(k).type) for k in keep]
            schema = pa.schema([("record_id", pa.string()), ("values", pa.map_(pa.string(), pa.string())), *kept, *([("error", pa.string())] if error else [])])
            out: list[dict] = []
            for i in range(batch.num_rows):
                document = batch.column(0)[i].as_py()
                if document is None:
                    continue
                own = {k: batch.column(n + 1)[i].as_py() for n, k in enumerate(keep)}
                if error and (fault := fault_of(document)):
                    out.append({**own, "error": fault})
                for record, values in records_of(document):
                    out.append({"record_id": record, "values": list(values.items()), **own})
                    if len(out) >= rows_a_batch:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in at.schema if f.name != "content")
    return at.mapInArrow(run, "record_id string, values map<string,string>" + kinds + (f", `{error}` string" if error else ""))


def read_xml(spark: SparkSession, path: str | list[str], now: Column, *, error: str | None = None) -> DataFrame:
    """Records of all .xml files below path, or at the paths, with lineage; error as in
    flatten_xml."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    named = files.select("content", F.element_at(F.split("path", "/"), -1).alias("landing_source_file"), files.metadataColumn("_metadata")["file_path"].alias("landing_source_path"))
    return flatten_xml(named, "content", ["landing_source_file", "landing_source_path"], error=error).withColumn("ingestion_timestamp", now.cast("timestamp_ntz"))
