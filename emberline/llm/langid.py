"""Language identification with n-gram filters that hold a bit for each language.

Character n-grams of lower-case words (with a blank on either side) are counted for
each language over all training rows. An n-gram belongs to every language in which
its share is at least `ratio` of its largest share. One bit-sliced Bloom filter holds
the n-grams of all languages: a slot is a mask of languages, and the masks of an
n-gram's slots, joined by AND, name all languages that contain it. The languages'
counts over a text, corrected for false positives, decide.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import discard, written
from ..operators.tables import free_names
from .common import WordMemo, release_memos, small_batches

ORDERS = (3, 4)
#: Runs of letters in texts without numerals other than digits; the Latin letters and
#: punctuation around the six of Latin-1 have none.
_PLAIN = re.compile(r"[^\W\d_]+")
_BEYOND = re.compile("[^\0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]")
LONGEST = 200  # longer words are taken in pieces of this many letters, so that a memo key is short


@cache
def _odd_numerals() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of one, and of runs of letters between: numerals like ½ ² ① are word
    characters without being letters or decimal digits."""
    odd = [i for i in range(0x110000) if chr(i).isnumeric() and not chr(i).isalpha() and not chr(i).isdecimal()]
    cuts = [k for k in range(1, len(odd)) if odd[k] != odd[k - 1] + 1]
    spans = "".join(f"\\U{odd[a]:08x}-\\U{odd[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(odd)], strict=True))
    return re.compile(f"[{spans}]"), re.compile(rf"[^\W\d_{spans}]+")


def word_list(text: str | None) -> list[str]:
    """Runs of letters (Unicode's, so no numerals and no marks) in lower case; a run of
    over LONGEST letters in pieces."""
    if not text:
        return []
    low = text.lower()
    odd, letters = _odd_numerals() if _BEYOND.search(low) else (None, _PLAIN)
    found = (letters if odd and odd.search(low) else _PLAIN).findall(low)
    if max(map(len, found), default=0) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def grams(word: str) -> list[str]:
    s = f" {word} "
    return [s[i : i + n] for n in ORDERS for i in range(len(s) - n + 1)]


@dataclass
class BitSlicedBloom:
    """slots: (size, words of 64 languages) masks; rates: false positives by language."""

    langs: list[str]
    slots: np.ndarray
    rates: np.ndarray
    hashes: int = 3

    @classmethod
    def build(cls, members: list[tuple[str, str]], *, slots_a_member: int = 8, hashes: int = 3) -> BitSlicedBloom:
        """members: (language, n-gram). The number of slots follows that of the members, so
        the rate of false positives doesn't grow with them."""
        langs = sorted({m[0] for m in members})
        bits = max(16, (slots_a_member * len(members)).bit_length())
        slots = np.zeros((1 << bits, -(-max(len(langs), 1) // 64)), np.uint64)
        at = {x: i for i, x in enumerate(langs)}
        where = cls._places([g for _, g in members], bits, hashes)
        ids = np.array([at[x] for x, _ in members], np.int64)
        for row in where:
            np.bitwise_or.at(slots, (row, ids // 64), np.uint64(1) << (ids % 64).astype(np.uint64))
        self = cls(langs, slots, np.zeros(len(langs)), hashes)
        fill = np.array([float((slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(langs))])
        self.rates = fill**hashes
        return self

    @staticmethod
    def _places(keys: list[str], bits: int, hashes: int) -> np.ndarray:
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        a, b = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(hashes)])

    def contains(self, keys: list[str]) -> np.ndarray:
        """(keys, languages): whether the filter has the n-gram for the language."""
        where = self._places(keys, len(self.slots).bit_length() - 1, self.hashes)
        mask = self.slots[where[0]]
        for row in where[1:]:
            mask = mask & self.slots[row]
        n = len(self.langs)
        return (mask[:, np.arange(n) // 64] >> (np.arange(n) % 64).astype(np.uint64) & np.uint64(1)).astype(np.int32)


class Scorer:
    """Predicts languages of texts; remembers the counts of frequent words."""

    def __init__(self, model: BitSlicedBloom):
        self.model, self.width = model, len(model.langs) + 1
        self.memo = WordMemo(self._words, longest=LONGEST)

    def _words(self, words: list[str]) -> list[bytes]:
        """For each word: its n-grams, and how many each language contains."""
        out: list[bytes] = []
        for i in range(0, len(words), 20_000):
            many = [grams(w) for w in words[i : i + 20_000]]
            sizes = np.array([len(g) for g in many])
            hits = self.model.contains([g for w in many for g in w])
            sums = np.add.reduceat(hits, np.cumsum(sizes) - sizes, axis=0)
            out += [r.tobytes() for r in np.concatenate([sizes[:, None], sums], axis=1).astype(np.int32)]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            words = word_list(t)
            if not words or not self.model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            n, *hits = np.frombuffer(b"".join(self.memo(words)), np.int32).reshape(-1, self.width).sum(axis=0, dtype=np.int64).tolist()
            true = np.clip((np.array(hits) - n * self.model.rates) / (1 - self.model.rates), 0, n) if n else np.zeros(len(hits))
            best = int(np.argmax(true))
            langs.append(self.model.langs[best])
            scores.append(float(true[best] / n) if n else 0.0)
        return langs, scores


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", ratio: float = 0.5, most_rows: int = 200_000) -> BitSlicedBloom:
    """The filter of docs' rows with a language and a text.

    A classifier's labelled rows may be bounded: about most_rows of them are drawn by a
    hash of text and language, all if there are fewer; that alone bounds the model. Every
    n-gram of these rows counts, whole texts, however rare it is, and the filter's size
    follows their number. Words are counted in each task first, so only sums are shuffled.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        words: defaultdict[str, Counter] = defaultdict(Counter)
        found: defaultdict[str, Counter] = defaultdict(Counter)

        def turn() -> None:
            for lang, own in words.items():
                to = found[lang]
                for w, n in own.items():
                    for g in grams(w):
                        to[g] += n
            words.clear()

        def rows() -> pa.RecordBatch:
            flat = [(lang, g, n) for lang, own in found.items() for g, n in own.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(word_list(text))
            if sum(map(len, words.values())) > 300_000:
                turn()
                if sum(map(len, found.values())) > 300_000:
                    yield rows()
        turn()
        yield rows()

    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows_n = known.count()
    if rows_n > most_rows:
        known = known.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < int((1 << 30) * most_rows / rows_n))
    sums = written(known.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    by_gram = Window.partitionBy("gram")  # a row for each language
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    share = sums.join(F.broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("total"))  # totals: a row for each language
    kept = share.withColumn("top", F.max("p").over(by_gram)).where(F.col("p") >= ratio * F.col("top"))
    members = [(r.lang, r.gram) for r in kept.select("lang", "gram").orderBy("lang", "gram").collect()]  # bounded by most_rows
    discard(sums)
    return BitSlicedBloom.build(members)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4. A
    null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _scored(docs: DataFrame, model: BitSlicedBloom, text_col: str, names: tuple[str, str]) -> DataFrame:
    """docs with the columns (predicted language, score) behind its own."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: slots of fixed size
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, scores = scorer(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: BitSlicedBloom, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row.

    score is the share of the text's n-grams that the predicted language contains,
    corrected for false positives. A text that is null or has no letters is `und` with
    score 0, and so is every text if nothing was learned. Ties go to the language that
    comes first in order. Null or repeated doc_ids and equal rows stay, a result for
    each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return _scored(rows, model, "text", ("lang_pred", "score")).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: BitSlicedBloom, *, text_col: str = "text", min_score: float = 0.25) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is found with a score of
    min_score at least; rows without letters go."""
    names = free_names(docs, "lang_pred", "lang_score")
    found = _scored(docs, model, text_col, tuple(names))
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= min_score)).select(*(F.col(f"`{c}`") for c in docs.columns))
