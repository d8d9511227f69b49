"""Token counts without ids: byte-pair merges by a heap over a linked list."""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, small_batches, words
from .word_pieces import LATIN_UNITS, halves, is_latin

_COUNTERS: dict = {}


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left when the adjacent pair of the lowest rank (the leftmost
    of equals) is merged again and again: initial symbols minus merges. A heap has
    the candidate pairs, the list of symbols is doubly linked, and a popped pair whose
    symbols have changed since is skipped."""
    n = left = len(symbols)
    sym: list[str | None] = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = a + b, None
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (r, h, sym[h], sym[i]))
    return left


class TokenCounter:
    """Counts the tokens of whole texts for a tokenizers file of the BPE kind with an
    end-of-word suffix, whose pre-tokenizer drops white space. Normalising and
    splitting of unusual words is the library's; the merges are done here."""

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix, self.vocab = model.get("end_of_word_suffix") or "", model["vocab"].keys()
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.bytes = {b: c for b, c in zip(range(256), self._byte_letters(), strict=True)}
        self.pieces = WordMemo(lambda many: [self._piece(p) for p in many], limit=50_000)
        self.memo = WordMemo(self._words, limit=700_000)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable letter that stands for each byte in byte-level vocabularies:
        itself if it is a visible Latin-1 character, else the next one from 256 on."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = iter(range(256, 512))
        return [chr(b) if b in visible else chr(next(shifted)) for b in range(256)]

    def _piece(self, piece: str) -> int:
        symbols = [*piece[:-1], piece[-1] + self.suffix]
        return count_merged([s for s in symbols if s in self.vocab], self.ranks)

    def _split(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if p]

    def _words(self, many: list[str]) -> list[int]:
        """Counts of words; letters in lower case are remembered as words themselves."""
        young, old = self.memo.young, self.memo.old
        out, fresh = [], {}
        for w in many:
            if (h := halves(w)) is None:
                found = self.special.findall(w) if self.special else []
                rest = self.special.split(w) if found else [w]
                out.append(len(found) + sum(sum(self.pieces(p)) for t in rest if t and (p := self._split(t))))
                continue
            body, tail = h
            n = young.get(body) or old.get(body) or fresh.get(body)
            if n is None:
                fresh[body] = n = self._piece("".join(map(self.bytes.__getitem__, body.encode())))
            out.append(n + sum(self.pieces([tail])) if tail else n)
        young.update((w, n) for w, n in fresh.items() if len(w) <= self.memo.longest)
        return out

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(self.memo(LATIN_UNITS.findall(text) if is_latin(text) else words(text)))


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, whole texts, no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated doc_ids and equal
    rows are kept, a result for each; an empty table gives an empty result; other
    columns are not read.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in batches:
            n = [tokens(t) for t in batch.column(1).to_pylist()]
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
