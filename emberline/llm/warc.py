"""WARC archives: one gzip member for each record, written and read sequentially."""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1
from uuid import UUID, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..operators.storage import discard
from .common import arrow_store, shared_dir, small_batches, written

_SPACE = UUID(int=0)
_END = b"\r\n\r\n"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return b32encode(sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


class WarcError(ValueError):
    """An archive that doesn't keep to the format."""


def record_bytes(*, uid: int, page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, int | None] | None = None) -> bytes:
    """A response record, or with refers_to (uid and page_id of the response) a revisit,
    which has the HTTP headers only. A gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid5(_SPACE, str(uid))}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to:
        headers += [("WARC-Refers-To", f"<urn:uuid:{uuid5(_SPACE, str(refers_to[0]))}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
        if refers_to[1] is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to[1])))
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + _END) + pack.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def parse_record(data: bytes) -> Record:
    """A record of its uncompressed bytes: framed by Content-Length, digests verified."""
    head, found, rest = data.partition(_END)
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    record = Record(_fields(lines[1:]))
    try:
        size = int(record.headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    record.block = rest[:size]
    if len(record.block) < size or rest[size:] != _END:
        raise WarcError("a record doesn't end where its Content-Length says")
    if (said := record.headers.get("warc-block-digest")) and said != f"sha1:{digest(record.block)}":
        raise WarcError("the block's digest differs")
    http, found, record.payload = record.block.partition(_END)
    if found:
        record.http = _fields(http.split(b"\r\n")[1:])
    said = record.headers.get("warc-payload-digest")
    if said and record.headers.get("warc-type") == "response" and said != f"sha1:{digest(record.payload)}":
        raise WarcError("the payload's digest differs")
    return record


def read_records(stream, chunk: int = 1 << 18) -> Iterator[Record]:
    """Records of a file, one after the other, by incremental decompression of a gzip
    member at a time. Holds a piece of the file and one record."""
    pending = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            pending = pending or stream.read(chunk)
            if not pending:
                if parts:
                    raise WarcError("the file ends within a record")
                return
            try:
                parts.append(member.decompress(pending))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            pending = member.unused_data
            if not member.eof:
                pending = b""
        yield parse_record(b"".join(parts))


def write_warc(pages: DataFrame, out: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, most_broadcast: int = 200_000) -> DataFrame:
    """Writes a record for each row to archives in the folder out, one for each task, and
    returns the table of their names and record counts.

    Of rows with equal payloads of min_revisit_bytes at least, the one of the largest
    page_id is the response (of several with that page_id one of them; null ids count
    as smallest), the others are revisits of it. A null payload is empty. An empty
    table gives archives without records. Other columns are not read. Equal payloads meet
    as digests only, by partial maximums. Which payloads are repeated is broadcast up to
    most_broadcast of them; beyond that rows meet it by lookup, so a payload that many rows
    share isn't gathered anywhere. A worker holds a batch of 16 MB, or one longer payload.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = written(pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("sha")), "pages")
    big = rows.where(F.octet_length("payload") >= min_revisit_bytes)
    tops = big.groupBy("sha").agg(F.max(F.struct("page_id", "uid")).alias("top"), F.count("*").alias("n"))
    tops = written(tops.where("n > 1"), "tops")
    repeated = tops.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).first()
    if repeated.kinds <= most_broadcast:  # 70 bytes a row
        met = big.join(F.broadcast(tops.drop("n")), "sha", "left")
    else:
        met = lookup(big, tops, ["sha"], total=repeated.rows)
    small = rows.where(F.octet_length("payload") < min_revisit_bytes).withColumn("top", F.lit(None).cast(tops.schema["top"].dataType))
    met = met.unionByName(small) if min_revisit_bytes else met
    revisit = F.col("top").isNotNull() & (F.col("top.uid") != F.col("uid"))
    table = met.select("uid", "page_id", "url", "payload", revisit.alias("revisit"), F.col("top.uid").alias("to_uid"), F.col("top.page_id").alias("to_page"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = arrow_store(out)
        store.create_dir(root, recursive=True)
        name, n = f"part-{context.partitionId()}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}.{context.taskAttemptId()}", compression=None) as f:
            for batch in batches:
                for r in batch.to_pylist():
                    f.write(record_bytes(uid=r["uid"], page_id=r["page_id"], url=r["url"], payload=r["payload"], refers_to=(r["to_uid"], r["to_page"]) if r["revisit"] else None))
                    n += 1
        store.move(f"{root}/{name}.{context.taskAttemptId()}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]}, schema=pa.schema([("name", pa.string()), ("records", pa.int64())]))

    table.mapInArrow(write, "name string, records long").write.parquet(f"{out}/manifest")
    discard(rows, tops)
    return spark.read.parquet(f"{out}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all
    archives in a folder that write_warc filled. Of a revisit, length and digest are
    those of the full payload, which the record itself doesn't hold. Raises WarcError
    where a record isn't framed as it says or a digest differs."""
    files = spark.read.parquet(f"{path}/manifest").where("records > 0")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows: list[dict] = []
                    held = 0
                    for r in read_records(f):
                        h = r.headers
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        rows.append({"page_id": number("x-page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": int(r.http["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number("x-refers-to-page-id"), "payload": r.payload if h["warc-type"] == "response" else None})
                        held += len(r.payload)
                        if held > 1 << 23 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return files.select("name").repartition(n, "name").mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to the shared folder and returns, for each row, what is read back
    without the payload: one row for each page, null ids and payloads, repeated and equal
    rows as in write_warc, nothing for an empty table."""
    out = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, out)
    return read_warc(pages.sparkSession, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
