"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A data set is a folder that holds, for each partition k in ascending doc_id order,

* ``ids-k.bin``: the token ids, little-endian, unsigned 16-bit if the vocabulary and
  the end id allow it, else 32-bit;
* ``offsets-k.bin``: little-endian signed 64-bit, one more than documents; document i
  of the partition has the ids from offsets[i] to offsets[i + 1];
* ``docs-k.bin``: little-endian signed 64-bit doc_ids, without the null ones, which
  come first;

and ``manifest``, a Parquet table with a row for each partition. A partition's place
in the whole stream (its base) is the prefix sum of the tokens before it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordMemo, arrow_store, partitions, shared_dir, small_batches, words
from .word_pieces import LATIN_UNITS, halves, is_latin

_ENCODERS: dict = {}


class WordEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space:
    each word is encoded by the library once and then remembered."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: By id, whether the token ends a word; None if the vocabulary doesn't tell.
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.memo = WordMemo(self._words, limit=700_000)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of halves of words. The library gets them in lines of many and the tokens
        that end a word tell them apart; a line with another number of ends than units
        is encoded unit by unit."""
        if self.ends is None:
            return self._library(units)
        out: list[bytes] = []
        lines = [units[i : i + 256] for i in range(0, len(units), 256)]
        for own, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(own) or cuts[-1] != len(ids):
                out += self._library(own)
                continue
            flat = ids.astype(self.dtype)
            at = (cuts * flat.itemsize).tolist()
            coded = flat.tobytes()
            out += [coded[a:b] for a, b in zip([0, *at], at, strict=False)]
        return out

    def _words(self, missing: list[str]) -> list[bytes]:
        """Ids of words: of their halves, which are remembered as words themselves, or, for
        words of another form, by the library."""
        young, old = self.memo.young, self.memo.old
        parts = [halves(w) for w in missing]
        units = dict.fromkeys(x for h in parts if h for x in h if x and x not in young and x not in old)
        fresh = dict(zip(units, self._joined(list(units)), strict=True))
        young.update((x, ids) for x, ids in fresh.items() if len(x) <= self.memo.longest)
        odd = iter(self._library([w for w, h in zip(missing, parts, strict=True) if h is None]))

        def known(x: str) -> bytes:
            for memo in (fresh, young, old):
                if (ids := memo.get(x)) is not None:
                    return ids
            return b""

        return [next(odd) if h is None else known(h[0]) + known(h[1]) for h in parts]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(self.memo(LATIN_UNITS.findall(text) if is_latin(text) else words(text)))


def encoder(path: str, dtype: str) -> WordEncoder:
    """One encoder a worker process."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def id_type(path: str, end_id: int) -> str:
    """The narrowest type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them as a data set (see the module) to the
    folder out, which all executors must reach. Returns the manifest.

    A null or empty text gives only the end id. Documents are in ascending doc_id
    order, null doc_ids first; rows of equal doc_id are in the order in which they are
    read, each with its own place. An empty table gives a data set without documents.
    Other columns are not read. Texts are shuffled by ranges of doc_id and, among equal or
    null ones, of that order, so rows of one doc_id may go to many files. (Their ids are no
    smaller than the texts where words are rare, so encoding first saves nothing.) A file
    is written under a name of its own attempt and then renamed, so a task that runs twice
    leaves one whole file. A worker holds a batch of 16 MB, or one longer text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    arrow_store(out)
    dtype, n = id_type(tokenizer_path, end_id), partitions(spark)
    end = np.array([end_id], dtype).tobytes()
    width = len(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = arrow_store(out)
        store.create_dir(root, recursive=True)
        names = {k: f"{root}/{k}-{part}.bin" for k in ("ids", "offsets", "docs")}
        encode, docs_n, nulls, tokens = encoder(tokenizer_path, dtype), 0, 0, 0
        files = {k: store.open_output_stream(f"{v}.{attempt}") for k, v in names.items()}
        files["offsets"].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            coded = [encode(t) + end for t in batch.column(1).to_pylist()]
            files["ids"].write(b"".join(coded))
            ends = tokens + np.cumsum([len(c) // width for c in coded], dtype="<i8")
            files["offsets"].write(ends.tobytes())
            ids = batch.column(0)
            nulls += ids.null_count
            files["docs"].write(ids.drop_null().to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs_n += len(coded)
            tokens = int(ends[-1]) if len(ends) else tokens
        for k, f in files.items():
            f.close()
            store.move(f"{names[k]}.{attempt}", names[k])
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_n], "null_ids": [nulls], "tokens": [tokens], "width": [width]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("null_ids", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.col("place")]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    schema = "part int, docs long, null_ids long, tokens long, width int"
    manifest = dealt.mapInArrow(write, schema).collect()  # a row for each partition, written as one file
    spark.createDataFrame(manifest, schema).coalesce(1).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def _opened(store: pafs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)


def read_tokens(spark: SparkSession, path: str, *, docs_at_once: int = 512, bytes_a_task: int = 32 << 20) -> DataFrame:
    """Reads a data set back: (doc_id, start, ids), ids as little-endian unsigned
    32-bit bytes. start counts the ids of all documents before. Files are memory-mapped
    where they are local and read by ranges where they are not. A task reads whole
    partitions, of about bytes_a_task together."""
    manifest = sorted(spark.read.parquet(f"{path}/manifest").collect())  # a row for each partition
    base, size, parts = 0, 0, []
    for r in manifest:
        if r.docs:
            parts.append((r.part, base, r.docs, r.null_ids, r.width))
        base += r.tokens
        size += r.tokens * r.width
    schema = "doc_id long, start long, ids binary"
    if not parts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_store(path)
        for batch in batches:
            for r in batch.to_pylist():
                dtype = np.dtype(f"<u{r['width']}")
                with _opened(store, f"{root}/ids-{r['part']}.bin") as ids, _opened(store, f"{root}/offsets-{r['part']}.bin") as offsets, _opened(store, f"{root}/docs-{r['part']}.bin") as docs:
                    for at in range(0, r["docs"], docs_at_once):
                        n = min(docs_at_once, r["docs"] - at)
                        offsets.seek(8 * at)
                        bounds = np.frombuffer(offsets.read(8 * (n + 1)), "<i8")
                        nulls = min(max(r["null_ids"] - at, 0), n)
                        docs.seek(8 * max(at - r["null_ids"], 0))
                        known = np.frombuffer(docs.read(8 * (n - nulls)), "<i8").tolist()
                        ids.seek(int(bounds[0]) * dtype.itemsize)
                        flat = np.frombuffer(ids.read(int(bounds[-1] - bounds[0]) * dtype.itemsize), dtype).astype("<u4")
                        cuts = (bounds - bounds[0]).tolist()
                        yield pa.RecordBatch.from_pydict({"doc_id": [None] * nulls + known, "start": (bounds[:-1] + r["base"]).tolist(), "ids": [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]}, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]))

    rows = spark.createDataFrame(parts, "part int, base long, docs long, null_ids long, width int")
    tasks = min(len(parts), max(spark.sparkContext.defaultParallelism, -(-size // bytes_a_task)))
    return rows.repartition(tasks).mapInArrow(read, schema)


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gave."""
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_output(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """Writes the documents' tokens to the shared folder and returns the digest of
    what is read back, a row for each document."""
    out = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, out, end_id=end_id)
    return token_digest(read_tokens(docs.sparkSession, out))


