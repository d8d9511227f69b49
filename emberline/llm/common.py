"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import weakref
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from ..operators.storage import placed, shared_dir, written

__all__ = ["ASCII_SPACE", "WORD", "NoArrowStore", "WordMemo", "arrow_store", "partitions", "placed", "release_memos", "shared_dir", "small_batches", "words", "written"]

#: Words are runs of everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"

_ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in ASCII_SPACE) + "]")
_ASCII_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str) -> list[str]:
    """The words of a text: split at ASCII white space only."""
    if _ODD_SPACE.search(text) is None:
        return text.split()
    return [w for w in _ASCII_SPACES.split(text) if w]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds what a Python worker gets at a time, by rows and by bytes (a longer text
    comes alone). Plans are made when they run, so this lowers the session's own bounds;
    lower ones of the caller stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class NoArrowStore(ValueError):
    """A shared folder that Spark reaches and Arrow's file systems don't."""


def arrow_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in which workers write files of a format that
    Spark has no writer for: local and shared mounts, HDFS, S3 (s3a too) and GCS."""
    try:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    except (pa.ArrowInvalid, OSError) as e:
        raise NoArrowStore(f"Arrow has no file system for {uri}") from e


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_MEMOS: weakref.WeakSet = weakref.WeakSet()
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


class WordMemo:
    """A bounded memo of a function of words, in two generations.

    compute gets a list of distinct words and returns their values (never None). A
    word is kept unless it is very long; when the younger generation is full it
    becomes the older one, so memory is bounded and frequent words stay.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 300_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}
        _MEMOS.add(self)

    def __call__(self, keys: list[str]) -> list:
        young = self.young
        missing = set(keys).difference(young)
        if not missing:
            return list(map(young.__getitem__, keys))
        known, new = {}, []
        for w in missing:
            v = self.old.get(w)
            if v is None:
                new.append(w)
            else:
                known[w] = v
        young.update(known)
        young.update(zip(new, self.compute(new) if new else (), strict=True))
        got = list(map(young.__getitem__, keys))
        for w in missing if len(missing) > self.limit else [w for w in new if len(w) > self.longest]:
            del young[w]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return got


def release_memos() -> None:
    """Empties the memos of this process and gives freed memory back. Python workers are
    reused by later operators, which call this first, so that one operator's words aren't
    held during the next."""
    for memo in list(_MEMOS):
        memo.young, memo.old = {}, {}
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
