"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, small_batches

_CODERS: dict = {}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBPE:
    """Encodes by a file of ranks: each match of the pattern apart, no special tokens."""

    #: A space between two characters that aren't white space always starts a match.
    SAFE = re.compile(r"(?<!\s)(?= (?!\s))")
    #: Characters of texts that WORDS splits: Latin, dashes, quotation marks, the euro sign.
    BEYOND = re.compile("[^\0-\u024f\u2010-\u2027\u20ac]")
    #: Of such texts: letters behind at most one white space, and what is between, where an
    #: apostrophe takes the letters behind it along. If a pattern takes letters, numbers
    #: and other characters apart, none of its matches goes over the end of such a chunk.
    LETTER = "".join(re.escape(chr(i)) for i in range(0x250) if chr(i).isalpha())
    BLANK = " \t\n\x0b\x0c\r\x85\xa0"
    WORDS = re.compile(f"[{BLANK}]?[{LETTER}]+|(?:'[{LETTER}]+|(?![{BLANK}]?[{LETTER}]).)+", re.DOTALL)
    APART = (r"| ?\p{L}+|", r"| ?\p{N}+|", r"| ?[^\s\p{L}\p{N}]+|", r"|\s+(?!\S)|\s+")

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = {i: b for b, i in self.ranks.items()}
        #: Ranks of two ids in a row, wherever their bytes together are a token.
        self.wide = max(self.ranks.values(), default=0).bit_length()
        self.pairs = {a << self.wide | b: r for t, r in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None}
        self.pattern = regex.compile(pattern)
        #: Bits of a rank that a word of the lower bitmap tells apart: two levels for any vocabulary.
        self.shift = (max(self.ranks.values(), default=0).bit_length() + 1) // 2
        self.bit = [1 << i for i in range(1 << self.shift)]
        self.byte_ids = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.apart = all(x in pattern for x in self.APART)
        self.pieces = WordMemo(lambda many: [packed(self.merge(p.encode())) for p in many], limit=50_000)
        self.memo = WordMemo(self._chunks, limit=450_000)

    def _chunks(self, many: list[str]) -> list[bytes]:
        """Ids of chunks of text. Letters behind at most a blank are one match."""
        plain = [self.apart and t[t[:1] == " " :].isalpha() for t in many]
        return [packed(self.merge(t.encode())) if p else b"".join(self.pieces(self.pattern.findall(t))) for t, p in zip(many, plain, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue has a bucket of positions for each rank and two levels of bitmaps: a
        bit of low[hi] for each rank with a bucket, a bit of top for each such word. A
        find-first-set on both gives the lowest rank, whose leftmost position is popped.
        rank_at has the rank of the pair that now starts at a position; an entry of
        another rank is stale and skipped.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        shift, bit, wide = self.shift, self.bit, self.wide
        n, known, within = len(piece), self.pairs.get, (1 << shift) - 1
        ids = list(map(self.byte_ids.__getitem__, piece))
        rank_at = [known(a << wide | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        rank_at.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = 0
        fresh = enumerate(rank_at)
        while True:
            for i, r in fresh:  # push
                if r < 0:
                    continue
                if (bucket := buckets.get(r)) is not None:
                    heapq.heappush(bucket, i)
                    continue
                buckets[r] = [i]
                hi = r >> shift
                low[hi] = low.get(hi, 0) | bit[r & within]
                top |= bit[hi]
            if not top:
                break
            first = top & -top  # pop
            hi = first.bit_length() - 1
            word = low[hi]
            last = word & -word
            rank = hi << shift | last.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[hi] = word = word ^ last
                if not word:
                    top ^= first
            if rank_at[i] != rank:
                fresh = ()
                continue
            j = after[i]
            ids[i], rank_at[j] = rank, -1
            after[i] = k = after[j]
            h = before[i]
            rank_at[i] = r = -1
            if k < n:
                before[k] = i
                rank_at[i] = r = known(rank << wide | ids[k], -1)
            if h >= 0:
                rank_at[h] = s = known(ids[h] << wide | rank, -1)
                fresh = ((i, r), (h, s))
            else:
                fresh = ((i, r),)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known = self.apart and self.BEYOND.search(text) is None
        return b"".join(self.memo(self.WORDS.findall(text) if known else self.SAFE.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row: ids as little-endian unsigned
    32-bit bytes and the bytes they decode to; with digest their SHA-256 instead,
    (doc_id, n_tokens, ids_sha256, decoded_sha256), which keeps the rows short.

    A null text counts as empty and has no ids. Null or repeated doc_ids and equal
    rows are kept, a result for each; an empty table gives an empty result; other
    columns are not read. No shuffle; a worker holds a batch of texts at a time.
    """
    small_batches(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                i = bpe.encode(t)
                d = bpe.decode(i)
                n.append(len(i) // 4)
                ids.append(sha256(i).hexdigest() if digest else i)
                decoded.append(sha256(d).hexdigest() if digest else d)
            kind = pa.string() if digest else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    kind = "string" if digest else "binary"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(code, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")
