"""Hard negatives by radix selection over integer scores.

Vectors are packed into blocks of rows, and so are the anchors; each block of anchors
meets the blocks of rows in groups that are dealt to tasks, which multiply them and keep
counts only. For a window of scores, a histogram over all rows says in which of 64
buckets the kth best score lies; the next round counts within that bucket, and where it
holds a single score, within buckets of ids, which decide ties. Once a bucket holds few
rows, the rows down to it are gathered, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import discard
from .common import partitions, small_batches, written
from .native import local_table

BUCKETS = 64
#: A bucket of so many rows is gathered instead of being counted once more.
FEW_ROWS = 64
#: Components are held within this, so that a score fits 64 bits up to 32 dimensions beyond 2^58.
MOST = 1 << 28

_BLOCK = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("uids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


def _pack(most_rows: int, most_bytes: int = 4 << 20):
    """Blocks of rows of (uid, vec_id, label, vector): shorter vectors end with zeros."""

    def block(ids: list, uids: list, labels: list, vectors: list) -> pa.RecordBatch:
        dim = max(map(len, vectors))
        matrix = np.zeros((len(vectors), dim), "<i4")
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        held = [np.array(c, "<i8").tobytes() for c in (ids, uids, labels)]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([h], pa.binary()) for h in (*held, matrix.tobytes()))], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        longest = 0
        for b in batches:
            uids, ids, labels = (b.column(i).to_pylist() for i in range(3))
            column = b.column(3)
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            for i in range(b.num_rows):
                v = flat[at[i] : at[i + 1]]
                if held[0] and (len(held[0]) >= most_rows or (len(held[0]) + 1) * 4 * max(longest, len(v)) > most_bytes):
                    yield block(*held)
                    held, longest = [[], [], [], []], 0
                for to, x in zip(held, (ids[i], uids[i], labels[i], v), strict=True):
                    to.append(x)
                longest = max(longest, len(v))
        if held[0]:
            yield block(*held)

    return run


class _Block:
    def __init__(self, row: dict, prefix: str = ""):
        get = lambda c: row[prefix + c]
        self.n, self.dim = get("n"), get("dim")
        self.ids, self.uids, self.labels = (np.frombuffer(get(c), "<i8") for c in ("ids", "uids", "labels"))
        self.vectors = np.frombuffer(get("vectors"), "<i4").reshape(self.n, self.dim)
        self.top = int(np.abs(self.vectors.astype("i8")).max(initial=0))

    def scores(self, rows: _Block, start: int, stop: int) -> np.ndarray:
        """Inner products of anchors start to stop with all rows, exactly."""
        d = min(self.dim, rows.dim)
        kind = "f8" if self.top * rows.top * max(d, 1) < 1 << 53 else "i8"
        return (self.vectors[start:stop, :d].astype(kind) @ rows.vectors[:, :d].astype(kind).T).astype("i8")


_WINDOW = ["slot", "w", "s_lo", "s_hi", "i_lo", "i_hi", "top"]


class _Windows:
    """The windows of a block of anchors, in order of their anchor."""

    def __init__(self, structs: pa.ListScalar):
        flat = structs.values
        order = np.lexsort([flat.field("w").to_numpy(), flat.field("slot").to_numpy()])
        for c in _WINDOW:
            setattr(self, c, flat.field(c).to_numpy()[order].astype("i8"))

    def met(self, anchors: _Block, rows: _Block, same: bool, counting: bool) -> Iterator[tuple]:
        """(windows, rows, scores) of the rows that lie in the windows, some anchors at a
        time. counting: only what is open still; else all from the window's top down to it."""
        step = max(1, (1 << 20) // max(rows.n, 1))
        for start in range(0, anchors.n, step):
            stop = min(start + step, anchors.n)
            a, b = np.searchsorted(self.slot, [start, stop])
            if a == b:
                continue
            scores = anchors.scores(rows, start, stop)
            alike = anchors.labels[start:stop, None] == rows.labels
            fit = alike & (anchors.uids[start:stop, None] != rows.uids) if same else ~alike
            for w in np.unique(self.w[a:b]):
                own = a + np.nonzero(self.w[a:b] == w)[0]
                at = self.slot[own] - start
                s = scores[at]
                high = self.s_hi if counting else self.top
                inside = fit[at] & (s >= self.s_lo[own, None]) & (s <= high[own, None])
                i, j = np.nonzero(inside)
                v, k = s[i, j], own[i]
                ids = rows.ids[j]
                single = self.s_lo[k] == self.s_hi[k]
                keep = ~single | ((ids >= self.i_lo[k]) & (ids <= self.i_hi[k])) if counting else (v > self.s_lo[k]) | (ids <= self.i_hi[k])
                yield k[keep], ids[keep], v[keep]

    def buckets(self, k: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The bucket of each row: from the highest score down, or from the smallest id up."""
        by_score = (self.s_hi[k] - scores) // ((self.s_hi[k] - self.s_lo[k]) // BUCKETS + 1)
        lo, hi = self.i_lo[k].view("u8"), self.i_hi[k].view("u8")
        by_id = ((ids.astype("i8").view("u8") - lo) // ((hi - lo) // np.uint64(BUCKETS) + np.uint64(1))).astype("i8")
        return np.where(self.s_lo[k] == self.s_hi[k], by_id, by_score)


_COUNTS = pa.schema([("ablock", pa.int64()), ("slot", pa.int64()), ("w", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([("ablock", pa.int64()), ("slot", pa.int64()), ("w", pa.int64()), ("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block of anchors, its number, its windows, block of rows); a block of anchors is
    the same object as long as its rows follow one another."""
    last, anchors, windows = None, None, None
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in b.schema.names}
            number = row["ablock"].as_py()
            if number != last:
                last, anchors, windows = number, _Block({c: v.as_py() for c, v in row.items() if c.startswith("a_")}, "a_"), _Windows(row["windows"])
            yield number, anchors, windows, _Block({c: row[c].as_py() for c in _BLOCK.names})


def _count(same: bool):
    """Rows of each bucket of each window, summed over the blocks of rows of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, windows = None, None, None

        def out() -> pa.RecordBatch:
            (i,) = np.nonzero(counts)
            k = i // BUCKETS
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(i), last), windows.slot[k], windows.w[k], i % BUCKETS, counts[i])], schema=_COUNTS)

        for number, anchors, w, rows in _groups(batches):
            if number != last:
                if last is not None:
                    yield out()
                last, windows, counts = number, w, np.zeros(len(w.slot) * BUCKETS, "i8")
            for k, ids, scores in windows.met(anchors, rows, same, True):
                if len(k):
                    cell = k * BUCKETS + windows.buckets(k, ids, scores)
                    low = int(cell.min())
                    seen = np.bincount(cell - low)
                    counts[low : low + len(seen)] += seen
        if last is not None:
            yield out()

    return run


def _gather(same: bool, best: int):
    """The best rows of each window among those down to its floor."""

    def cut(held: list[tuple]) -> list[tuple]:
        k, ids, scores = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort([ids, -scores, k])
        k, ids, scores = k[order], ids[order], scores[order]
        start = np.r_[0, np.nonzero(np.diff(k))[0] + 1] if len(k) else np.zeros(0, int)
        keep = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)])) < best
        return [(k[keep], ids[keep], scores[keep])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, of, windows, size = None, [], None, None, 0

        def out() -> pa.RecordBatch:
            ((k, ids, scores),) = cut(held)
            slot = windows.slot[k]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(k), last), slot, windows.w[k], of.ids[slot], ids, scores)], schema=_FOUND)

        for number, anchors, w, rows in _groups(batches):
            if number != last:
                if held:
                    yield out()
                last, of, windows, held, size = number, anchors, w, [], 0
            for found in windows.met(anchors, rows, same, False):
                held.append(found)
                size += len(found[0])
                if size > 1 << 20:
                    held = cut(held)
                    size = len(held[0][0])
        if held:
            yield out()

    return run


class _Scorer:
    """Blocks of rows and anchors, and how they meet."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, rows_a_block: int, anchors_a_block: int):
        spark = self.spark = rows.sparkSession
        kinds = "n int, dim int, ids binary, uids binary, labels binary, vectors binary"
        columns = ["uid", "vec_id", "label", "vector"]
        self.rows = written(rows.select(*columns).mapInArrow(_pack(rows_a_block), kinds), "row_blocks")
        spread = anchors.select(*columns).repartition(max(1, -(-anchors.count() // anchors_a_block)), F.xxhash64("uid"))
        packed = written(spread.mapInArrow(_pack(anchors_a_block, 1 << 30), kinds).withColumn("key", F.monotonically_increasing_id()), "packed_anchors")
        keys = [r.key for r in packed.select("key").collect()]  # one for each block of anchors
        numbers = local_table(spark, list(zip(keys, range(len(keys)), strict=True)) or [(-1, -1)], "key long, ablock long")
        named = packed.join(F.broadcast(numbers), "key")
        self.anchors = written(named.select("ablock", *(F.col(c).alias(f"a_{c}") for c in _BLOCK.names)), "anchor_blocks")
        discard(packed)
        self.blocks = len(keys)
        self.salts = max(1, -(-partitions(spark) // max(self.blocks, 1)))

    def met(self, windows: DataFrame) -> DataFrame:
        """Each block of rows with each block of anchors that has windows. Rows are copied to
        every block of anchors, a block of anchors to some groups of rows."""
        packed = windows.groupBy("ablock").agg(F.collect_list(F.struct(*_WINDOW)).alias("windows"))
        asked = self.anchors.join(packed, "ablock").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        dealt = self.rows.withColumns({"salt": F.pmod(F.xxhash64("uids"), F.lit(self.salts)).cast("int"), "ablock": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.blocks - 1).cast("long")))})
        return dealt.join(asked.hint("merge"), ["ablock", "salt"]).drop("salt")

    def best(self, windows: DataFrame, k: int, same: bool, id_range: tuple[int, int]) -> DataFrame:
        """(ablock, slot, w, anchor_id, id, score, rank): the first k rows of each window of
        (ablock, slot, w, s_lo, s_hi), highest scores first, then smallest ids. same: rows
        of the anchor's label, the anchor itself excepted; else those of other labels."""
        key = ["ablock", "slot", "w"]
        kept = ["top", "s_lo", "s_hi", "i_lo", "i_hi", "need", "open"]
        lo, hi = (F.lit(x).cast("long") for x in id_range)
        now = written(windows.select(*key, F.col("s_hi").alias("top"), "s_lo", "s_hi", lo.alias("i_lo"), hi.alias("i_hi"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open")), "windows")
        while not (left := now.where("open")).isEmpty():
            counts = self.met(left).mapInArrow(_count(same), "ablock long, slot long, w long, bucket long, n long").groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
            each = Window.partitionBy(*key)
            run = counts.withColumn("upto", F.sum("n").over(each.orderBy("bucket")))  # at most 64 rows of a window
            hit = run.join(left.select(*key, "need"), key).where("upto >= need").groupBy(*key).agg(F.min(F.struct("bucket", "n", "upto")).alias("hit")).select(*key, "hit.*")
            met = now.join(hit, key, "left")
            single = F.col("s_lo") == F.col("s_hi")
            wide = lambda a, b: F.expr(f"cast((cast({b} as decimal(20,0)) - cast({a} as decimal(20,0))) div {BUCKETS} as long) + 1")
            s_hi = F.when(single, F.col("s_hi")).otherwise(F.col("s_hi") - F.col("bucket") * wide("s_lo", "s_hi"))
            i_lo = F.when(single, F.col("i_lo") + F.col("bucket") * wide("i_lo", "i_hi")).otherwise(F.col("i_lo"))
            s_lo = F.when(single, F.col("s_lo")).otherwise(F.greatest("s_lo", s_hi - wide("s_lo", "s_hi") + 1))
            i_hi = F.when(single & (F.col("bucket") < BUCKETS - 1), F.least(F.col("i_hi"), i_lo + (wide("i_lo", "i_hi") - 1))).otherwise(F.col("i_hi"))
            found = F.col("bucket").isNotNull() & F.col("open")
            ended = (F.col("n") <= FEW_ROWS) | (single & (i_lo == i_hi))
            step = {"s_lo": s_lo, "s_hi": s_hi, "i_lo": i_lo, "i_hi": i_hi, "need": F.col("need") - (F.col("upto") - F.col("n")), "open": ~ended}
            new = met.select(*key, "top", *(F.when(found, v).otherwise(F.lit(False) if c == "open" else F.col(c)).alias(c) for c, v in step.items()))
            last, now = now, written(new.select(*key, *kept), "windows")
            discard(last)
        rows = self.met(now).mapInArrow(_gather(same, k), "ablock long, slot long, w long, anchor_id long, id long, score long")
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
        out = written(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        discard(now)
        return out


def hard_negatives(rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows_a_block: int = 4096, anchors_a_block: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its first `positives` other rows of its label, the first `negatives`
    rows of other labels whose score is from low to high per cent of the positive's.

    anchor: which rows are anchors, a condition on the columns of rows. A component x counts
    as floor(scale * x), held within 2^28 either way; a score is the integer inner product
    with the anchor, missing components of shorter vectors being 0. Higher scores come
    first, then smaller ids. Rows with a null id, label or vector, or with a null or
    non-finite component, take no part. Repeated rows and rows of one id are rows of their
    own (as anchors too), so a copy of an anchor may be its positive. A positive whose score
    is below 0 has no window. No anchors: an empty result. Other columns are not read.

    No rows are dropped: equal scores, however many, are told apart by id. A task holds a
    block of anchors, counts for its windows and one block of rows; counts and windows meet
    as tables. Each block of rows is copied to every anchors_a_block anchors.
    """
    spark = rows.sparkSession
    small_batches(spark)
    vec = F.col(f"`{vector_col}`")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    named = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & vec.isNotNull() & F.forall(vec, fine))
    stored = written(named.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(vec, whole).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")), "vectors")
    facts = stored.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"), F.max(F.size("vector")).alias("dim"), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))).alias("top")).first()
    scorer = _Scorer(stored, stored.where("anchor"), rows_a_block, anchors_a_block)
    if not scorer.blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ids, far = (facts.a, facts.b), min((facts.top or 0) ** 2 * facts.dim, (1 << 62) - 1)
    slots = scorer.anchors.select("ablock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_n").cast("long") - 1)).alias("slot"))
    whole_range = slots.select("ablock", "slot", F.lit(0).cast("long").alias("w"), F.lit(-far).cast("long").alias("s_lo"), F.lit(far).cast("long").alias("s_hi"))
    like = scorer.best(whole_range, positives, True, ids)
    bound = lambda x, part: F.expr(f"cast({x}(cast(score as decimal(20,0)) * {part} / 100) as long)")
    pairs = written(like.where("score >= 0").select("ablock", "slot", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), bound("ceil", low).alias("s_lo"), bound("floor", high).alias("s_hi")).where("s_lo <= s_hi"), "pairs")
    unlike = scorer.best(pairs, negatives, False, ids)
    discard(scorer.rows, scorer.anchors, stored, like)
    found = unlike.join(pairs.select("ablock", "slot", "w", "positive_id", "positive_score"), ["ablock", "slot", "w"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
