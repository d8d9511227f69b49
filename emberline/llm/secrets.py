"""Secrets in texts: patterns, and values that would take many guesses.

Patterns find assigned credentials, access keys and long hexadecimal runs. Beyond those,
the value of every credential context (a name like `pwd`, a colon or equals sign, a run
of characters) is judged by what guessing it costs: of all ways to cut the value into
words, dates, repeats, keyboard walks and brute-force spans, the cheapest one counts. A
word costs as many guesses as it is rare among the words of all texts outside such
values, so a secret doesn't vouch for itself, however often it is repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from math import comb, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..operators.storage import discard
from .common import small_batches, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A name in whose context a value is judged may end a longer one (db_pwd), the short ones excepted.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private)_?key|(?<![A-Za-z])(?:auth|bearer|pin))["']?\x20*[:=]\x20*["']?([^\s"'<>]{6,})""", re.ASCII | re.IGNORECASE)
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "pin")
_TAIL = ".,;:!?)]}"

_LEET = str.maketrans("01345789@$!|+", "oleastbgasilt")
_WORD_RUN = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order; kinds 0 assign, 1 access, 2 hex.
    Each kind is matched leftmost and without overlap, then short matches are dropped:
    assigned values of under 8, access keys of under 16, hex runs of under 32 characters."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the values of 6 characters or more in credential contexts,
    without closing punctuation."""
    low = text.lower()
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(_TAIL)
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) >= 6:
            out.append((start, end, value))
    return out


def pieces(value: str) -> list[str]:
    """What of a value may be a word: letters within runs of them, lower-cased, as they are
    and with look-alike digits and signs read as letters."""
    low, out = value.lower(), set()
    for text in {low, low.translate(_LEET)}:
        for m in _WORD_RUN.finditer(text):
            run = m[0]
            out.update(run[i:j] for i in range(len(run)) for j in range(i + SHORTEST, min(i + LONGEST, len(run)) + 1))
    return sorted(out)


_ROWS = (("`1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}:"<>?', "`1234567890-=[];',./")


@cache
def _keys() -> dict[str, tuple[int, float]]:
    return {c: (y, x + shift) for y, (row, shift) in enumerate(_ROWS) for x, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbouring one, None if they aren't neighbours."""
    keys = _keys()
    if a not in keys or b not in keys or a == b:
        return None
    (y, x), (v, u) = keys[a], keys[b]
    if abs(v - y) > 1 or abs(u - x) > 1:
        return None
    return v - y, (u > x) - (u < x)


_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})|(19\d\d|20\d\d))")


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of dates and years."""
    for start in range(len(value)):
        if not "0" <= value[start] <= "9":
            continue
        for end in range(start + 4, min(start + 10, len(value)) + 1):
            m = _DATE.fullmatch(value, start, end)
            if not m:
                continue
            if m[9]:
                yield start, end, log10(max(abs(int(m[9]) - 2025), 20))
                continue
            year, one, two, sign = (m[1], m[3], m[4], m[2]) if m[1] else (m[8], m[5], m[7], m[6])
            one, two, year = int(one), int(two), int(year) if len(year) == 4 else 2000
            if 1 <= min(one, two) <= 12 and 1 <= max(one, two) <= 31 and 1000 <= year <= 2100:
                yield start, end, log10(365 * max(abs(year - 2025), 20)) + (log10(4) if sign else 0)


_REPEAT = re.compile(r"(.{1,16}?)\1+", re.DOTALL)


def _alphabet(value: str) -> float:
    """log10 of how many characters a guesser of single characters has to try."""
    size = 10 * any(c.isdecimal() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() and not c.isdecimal() for c in value)
    return log10(max(size, 2))


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes. words: the cost
    of each known word in it. Each further segment doubles the guesses."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, single = low.translate(_LEET), _alphabet(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for text in (low, plain) if plain != low else (low,):
        for m in _WORD_RUN.finditer(text):
            for i in range(m.start(), m.end()):
                for j in range(i + SHORTEST, min(i + LONGEST, m.end()) + 1):
                    if (cost := words.get(text[i:j])) is not None:
                        upper = sum(c.isupper() for c in value[i:j])
                        if upper in (j - i, 1) and upper and (upper > 1 or value[i].isupper()):
                            cost += log10(2)
                        elif upper:
                            cost += log10(sum(comb(j - i, k) for k in range(1, upper + 1)))
                        ends[j].append((i, cost + log10(2) * sum(a != b for a, b in zip(low[i:j], text[i:j], strict=True))))
    for i, j, cost in _dates(value):
        ends[j].append((i, cost))
    keys = low.translate(_SHIFTED)
    i = 0
    while i < n - 2:
        j, turns, last = i + 1, 0, None
        while j < n and (to := _step(keys[j - 1], keys[j])) is not None:
            turns, last = turns + (to != last), to
            j += 1
            if j - i >= 3:
                shifted = sum(a != b for a, b in zip(value[i:j], keys[i:j], strict=True))
                cost = log10(47 * (j - i)) + turns * log10(6) + (log10(2) if shifted in (0, j - i) else log10(comb(j - i, min(shifted, 64)) + 1)) * bool(shifted)
                ends[j].append((i, cost))
        i = max(j - 1, i + 1)
    repeats = [(m.start(), m.end(), len(m[1])) for m in _REPEAT.finditer(value)]
    for start, end, unit in repeats:
        own = min(unit * single, guess_cost(value[start : start + unit], words) if unit > 2 else unit * single)
        for times in range(2, (end - start) // unit + 1):
            ends[start + times * unit].append((start, own + log10(times)))
    best, brute = [0.0] + [float("inf")] * n, [float("inf")] * (n + 1)  # brute: the last segment is a brute-force span
    more = log10(2)
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + (more if j > 1 else 0)) + single
        best[j] = min([brute[j], *(best[i] + (more if i else 0) + cost for i, cost in ends[j])])
    return best[n]


_FOUND = "n_assign long, n_access long, n_hex long, base array<struct<start:int,kind:int,end:int>>, asked array<struct<start:int,end:int,value:string>>"
_FOUND_TYPE = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), ("asked", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])))])


def _search(text: str) -> dict:
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    asked = [dict(zip(("start", "end", "value"), v, strict=True)) for v in context_values(text)]
    return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "asked": asked}


def _search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([_search(t) for t in b.column(1).to_pylist()], _FOUND_TYPE)
        yield pa.RecordBatch.from_arrays([b.column(0), *found.flatten()], names=["doc_id", *(f.name for f in _FOUND_TYPE)])


def find_secrets(docs: DataFrame, *, least_guesses: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, spans, n_guess): a row for each row of docs; spans
    is an array of (start, kind, end) in code points, end exclusive, in order of start, then
    kind: 0 assign, 1 access, 2 hex, 3 guess.

    The first three are the patterns' matches (see base_spans). guess: the value of a
    credential context, within such a match or not, if guessing it takes 10 ** least_guesses
    guesses at least. Null and empty texts have no spans; long texts are searched whole;
    null, repeated and equal rows stay rows of their own; an empty table gives an empty
    result; other columns are not read. A word's cost is the log of how rare it is: the
    words of all texts (runs of letters, lower-cased) over its occurrences outside
    credential values; words that occur only within such values have none.

    Texts are read twice: for spans, and, where there are values to judge, for the words,
    which are counted before they are shuffled. Each distinct value is judged once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    found = written(rows.mapInArrow(_search_all, f"doc_id long, {_FOUND}").withColumn("uid", F.monotonically_increasing_id()), "found")
    asked = found.where(F.size("asked") > 0).select("uid", F.explode("asked").alias("a")).select("uid", "a.*")
    base = F.col("base").cast("array<struct<start:int,kind:int,end:int>>")
    out = found.select("uid", "doc_id", "n_assign", "n_access", "n_hex", base.alias("spans"))
    values = written(asked.groupBy("value").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "values")
    if values.isEmpty():
        return out.select("doc_id", "n_assign", "n_access", "n_hex", "spans", F.lit(0).cast("long").alias("n_guess"))
    secret = _judged(rows, asked, values, least_guesses)
    hits = lookup(asked, secret, ["value"], total=values.agg(F.sum("n")).first()[0], how="inner")
    more = hits.groupBy("uid").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("more"))
    met = out.join(more, "uid", "left")
    extra = F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return met.select("doc_id", "n_assign", "n_access", "n_hex", F.array_sort(F.concat("spans", extra)).alias("spans"), F.size(extra).cast("long").alias("n_guess"))


def _runs(text: str) -> Column:
    """The words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _judged(rows: DataFrame, asked: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(value, n): the values that take 10 ** least guesses or more."""
    cut = F.udf(pieces, "array<string>", useArrow=True)
    parts = written(values.select("number", F.explode(cut("value")).alias("word")), "pieces")  # no row holds a long value
    wanted = written(parts.groupBy("word").agg(F.count("*").alias("n")), "wanted")
    held = asked.select(F.explode(_runs("value")).alias("word")).groupBy("word").agg(F.count("*").alias("inside"))
    counts = rows.select(F.explode(_runs("text")).alias("word")).groupBy("word").agg(F.count("*").alias("all"))
    counts = written(counts, "words")
    total = counts.agg(F.sum("all")).first()[0] or 1
    outside = F.col("all") - F.coalesce("inside", F.lit(0))
    known = counts.join(wanted, "word").join(held, "word", "left").where(outside > 0).select("word", "n", F.log10(F.lit(float(total)) / outside).alias("cost"))
    known = written(known, "known")
    met = lookup(parts, known, ["word"], total=known.agg(F.sum("n")).first()[0] or 0, how="inner") if not known.isEmpty() else parts.where("false").withColumn("cost", F.lit(0.0))
    lists = met.groupBy("number").agg(F.collect_list("word").alias("words"), F.collect_list("cost").alias("costs"))
    cost = F.udf(lambda v, w, c: guess_cost(v, dict(zip(w or [], c or [], strict=True))), "double", useArrow=True)
    done = written(values.join(lists, "number", "left").withColumn("cost", cost("value", "words", "costs")).where(F.col("cost") >= least).select("value", "n"), "secrets")
    discard(parts, wanted, counts, known)
    return done
