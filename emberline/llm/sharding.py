"""Shards of near equal bytes by sampled splitters, in DataFrame functions alone.

Records are keyed by the hash of their text, so equal texts stay together. Key samples
are drawn with chances in proportion to size; their quantiles are the boundaries of
fine ranges, many to a shard. The exact size of every range is then summed over all
records; overfull ranges are subdivided, and ranges go to shards largest first, each to
the shard with the fewest bytes so far.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .native import local_table

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Range:
    """Keys lo..hi; parts: records are dealt to that many pieces by their row number."""

    lo: int
    hi: int
    parts: int = 1


def quantile_ranges(sample: list[tuple[int, float]], target: float) -> list[Range]:
    """Ranges over all keys that hold about `target` of the sample's weight each. A key
    that alone holds as much gets a range of its own."""
    weights: dict[int, float] = {}
    for k, w in sample:
        weights[k] = weights.get(k, 0.0) + w
    out, lo, held = [], LOW, 0.0
    for k in sorted(weights):
        if weights[k] >= target:
            if lo < k:
                out.append(Range(lo, k - 1))
            out.append(Range(k, k))
            lo, held = k + 1, 0.0
            continue
        held += weights[k]
        if held >= target:
            out.append(Range(lo, k))
            lo, held = k + 1, 0.0
    if lo <= HIGH:
        out.append(Range(lo, HIGH))
    return out


def subdivide(ranges: list[Range], sizes: dict[int, tuple[int, int]], target: float, most_rows: int, by_key: bool) -> list[Range]:
    """Ranges of over twice the target's bytes or over most_rows rows (sizes: both by range)
    in pieces: with by_key, spans of keys are cut into equal spans; a single key, or else
    any range, is dealt by row number."""
    out = []
    for i, r in enumerate(ranges):
        size, rows = sizes.get(i, (0, 0))
        n = max(-(-size // max(int(target), 1)), -(-rows // most_rows))
        if r.parts > 1 or size <= 2 * target and rows <= most_rows:
            out.append(r)
        elif by_key and r.hi - r.lo + 1 >= n:
            cuts = [r.lo + (r.hi - r.lo + 1) * j // n for j in range(n)] + [r.hi + 1]
            out += [Range(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            out.append(replace(r, parts=n))
    return out


def pack(pieces: list[tuple[int, int, int, int]], shards: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(range, part, bytes, rows) -> {(range, part): (shard, first slot)}. A range's parts
    stay together if they fit a shard; units go largest first to the emptiest shard."""
    share = sum(p[2] for p in pieces) / shards
    by_range: dict[int, list] = {}
    for p in pieces:
        by_range.setdefault(p[0], []).append(p)
    units = []
    for own in by_range.values():
        units += [own] if sum(p[2] for p in own) <= share else [[p] for p in own]
    load, place = [0] * shards, {}
    for unit in sorted(units, key=lambda u: (-sum(p[2] for p in u), u[0][:2])):
        to = min(range(shards), key=lambda s: (load[s], s))
        load[to] += sum(p[2] for p in unit)
        place.update({p[:2]: to for p in unit})
    slots, out = [0] * shards, {}
    for p in sorted(pieces):
        to = place[p[:2]]
        out[p[:2]] = (to, slots[to])
        slots[to] += p[3]
    return out


def _in_ranges(records: DataFrame, ranges: list[Range]) -> DataFrame:
    """records with their range and part: an equi-join on the leading bits of the key,
    with a row for each range and span of leading bits. Broadcast: the number of ranges
    is a parameter, and follows the number of rows only at rows_per_range."""
    bits = max(8, min(20, len(ranges).bit_length()))
    shift = 64 - bits
    rows = [(b, r.lo, r.hi, i, r.parts) for i, r in enumerate(ranges) for b in range(r.lo >> shift, (r.hi >> shift) + 1)]
    table = local_table(records.sparkSession, rows, "bin long, lo long, hi long, piece int, parts int")
    met = records.join(F.broadcast(table), (F.shiftright("key", shift) == F.col("bin")) & F.col("key").between(F.col("lo"), F.col("hi")))
    return met.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("bin", "lo", "hi", "parts")


def _sizes(records: DataFrame, *by: str) -> list:
    return records.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # a row for each range


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, ranges_per_shard: int = 64, rows_per_range: int = 1_000_000, sample_per_range: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row: law
    `bytes`, shards 0 to shards - 1 of near equal bytes (size: UTF-8 bytes of the text
    plus 1), slots from 0 without gaps in each shard, grown_shard null.

    Equal texts have one key and share a shard; only where they exceed a shard's share
    are they subdivided, by row. A null text has size 1, the crc of an empty one, and a
    key of its own. A very long text is a record like any other. Null or repeated doc_ids
    and equal rows stay, each with a slot; slots of a range follow key, doc_id and the
    order in which rows were read, which decides ties; an empty table gives an empty
    result; other columns are not read.

    The texts are read once; what is kept of a row is five numbers. The sample is
    bounded by the number of ranges; shard and slot come from exact sums over all rows.
    Rows are numbered within a range (rows_per_range at most on average, subdivided
    where it has over four times the mean rows or twice the mean bytes, so that many tiny
    or null texts are split too), and ranges by prefix sums, so no task sees a whole shard.
    """
    text = F.col(text_col)
    body = F.coalesce(text.cast("string"), F.lit(""))
    records = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "records")
    total = records.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    law = F.lit("bytes").alias("law")
    if not total.rows:
        return records.select("doc_id", "size", "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    fine = shards * max(ranges_per_shard, -(-total.rows // (shards * rows_per_range)))
    target, most_rows = total.bytes / fine, max(1, 4 * total.rows // fine)
    unit = total.bytes / (fine * sample_per_range)  # a record of this size is drawn for sure
    chance = F.pmod(F.xxhash64(F.col("uid"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = records.where(chance * unit < F.col("size")).select("key", F.greatest(F.col("size").cast("double"), F.lit(unit)).alias("weight"))
    ranges = quantile_ranges([(r.key, r.weight) for r in drawn.collect()], target)
    for by_key in (True, False):
        sizes = {r.piece: (r.bytes, r.rows) for r in _sizes(_in_ranges(records, ranges), "piece")}
        ranges = subdivide(ranges, sizes, target, most_rows, by_key)
    placed = _in_ranges(records, ranges)
    slots = pack([(r.piece, r.part, r.bytes, r.rows) for r in _sizes(placed, "piece", "part")], shards)
    bases = local_table(docs.sparkSession, [(*k, *v) for k, v in slots.items()], "piece int, part int, shard int, base long")
    own = Window.partitionBy("piece", "part").orderBy("key", "doc_id", "uid")
    numbered = placed.withColumn("at", F.row_number().over(own))
    found = numbered.join(F.broadcast(bases), ["piece", "part"])
    return found.select("doc_id", "size", "text_crc32", law, "shard", (F.col("base") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
