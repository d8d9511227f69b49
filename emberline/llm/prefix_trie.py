"""The trie of conversation prefixes, by rolling fingerprints.

A prefix's fingerprint is a polynomial in the hashes of its turns, modulo the prime
2^61 - 1. Those of all prefixes come from numpy scans over ranges of sorted turns; as
polynomials of pieces compose, a conversation may span several ranges, and one that
takes its first turns from another needs no second scan. Prefixes of equal length and
fingerprint are a candidate node. Each is verified: every member's last turn is compared
with that of the representative, the smallest conversation, and members that differ are
split off. (Equal fingerprints and equal last turns leave equal fingerprints one turn
before, so the turns of all depths together prove whole prefixes.) Counts are then
rolled up from children to parents in rounds that double the distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..operators.storage import discard
from ..operators.tables import free_names
from .common import partitions, placed, small_batches, written
from .native import local_table

P = (1 << 61) - 1
BASE = 0x0B3A_91D7_52C4_E86F % P
#: A conversation takes at most so many turns from another.
MOST_FORKED = 64
#: So many rows of a few numbers are few enough for one task if they all have one key.
FEW_ROWS = 250_000

_U = np.uint64


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, of unsigned values below P, in halves that don't overflow."""
    ah, al, bh, bl = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    mid = al * bh + ah * bl
    total = ah * bh * _U(2) + (mid >> _U(30)) + ((mid & _U(0x3FFFFFFF)) << _U(31)) + al * bl
    return _mod(total)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x >> _U(61)) + (x & _U(P))
    return np.where(x >= _U(P), x - _U(P), x)


def power(n: np.ndarray) -> np.ndarray:
    """BASE to the powers n (not negative), modulo P."""
    out, square, n = np.ones(len(n), _U), BASE, n.copy()
    while n.any():
        out = np.where(n & 1, mulmod(out, np.full(1, square, _U)), out)
        square, n = square * square % P, n >> 1
    return out


def scan(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of all prefixes of each conversation: x are the turns' values, at each
    turn's place in its conversation, from 0. Doubles the length that is summed."""
    out, step = x.copy(), 1
    far = int(at.max(initial=0))
    while step <= far:
        (i,) = np.nonzero(at >= step)
        out[i] = _mod(out[i] + mulmod(out[i - step], power(np.array([step]))))
        step *= 2
    return out


_SCANNED = pa.schema([("conv_id", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("bytes", pa.int64()), ("range", pa.int32()), ("pos", pa.int64()), ("fp", pa.int64()), ("before", pa.int64()), ("end", pa.bool_())])


def _scan_range(bits: int):
    """Numbers and fingerprints of the turns of one range of the sorted turns, as if no turn
    came before it, and a row marked `end` that repeats its last turn's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ended = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            conv, h = (b.column(i).to_numpy() for i in (0, 4))
            first = np.r_[True, conv[1:] != conv[:-1]]
            start = np.r_[np.nonzero(first)[0], len(conv)]
            at = np.arange(len(conv)) - np.repeat(start[:-1], np.diff(start))
            x = _mod((h.astype(_U) & _U((1 << bits) - 1)) + _U(1))
            fp, pos = scan(x, at), at + 1
            before = np.where(first, _U(0), np.r_[_U(0), fp[:-1]])
            if ended is not None and conv[0] == ended[0]:
                n = start[1]
                carry, own = np.full(n, ended[2], _U), pos[:n]
                fp[:n] = _mod(fp[:n] + mulmod(carry, power(own)))
                before[:n] = _mod(before[:n] + mulmod(carry, power(own - 1)))
                pos[:n] += ended[1]
            ended = (int(conv[-1]), int(pos[-1]), int(fp[-1]))
            numbers = [pa.array(v.astype("int64")) for v in (pos, fp, before)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(np.full(len(conv), part, "int32")), *numbers, pa.array(np.zeros(len(conv), bool))], schema=_SCANNED)
        if ended is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": ended[0], "range": part, "pos": ended[1], "fp": ended[2], "end": True}], schema=_SCANNED)

    return run


def _moved(fp: pd.Series, steps: pd.Series, plus: pd.Series) -> pd.Series:
    moved = mulmod(fp.to_numpy().astype(_U), power(steps.to_numpy()))
    return pd.Series(_mod(moved + plus.to_numpy().astype(_U)).astype("int64"))


def advance(fp: str, steps: Column | str, plus: str) -> Column:
    """A fingerprint followed by `steps` turns whose own fingerprint is `plus`."""
    return F.pandas_udf(_moved, "long")(fp, steps, plus)


def _carried(ends: list) -> list[tuple[int, int, int, int]]:
    """(range, conv_id, turns, fingerprint) of the conversation that a range's beginning may
    go on with, from the last rows of all ranges."""
    out, conv, pos, fp = [], None, 0, 0
    for r in sorted(ends, key=lambda r: r.range):
        if conv is not None:
            out.append((r.range, conv, pos, fp))
        if conv == r.conv_id:
            pos, fp = pos + r.pos, (fp * pow(BASE, r.pos, P) + r.fp) % P
        else:
            conv, pos, fp = r.conv_id, r.pos, r.fp
    return out


def _fingerprints(turns: DataFrame, bits: int) -> DataFrame:
    """(conv_id, file, row, bytes, pos, fp, before) of all turns: place in the conversation
    from 1, fingerprint of the prefix that ends with it, and of the one before."""
    spark = turns.sparkSession
    h = F.xxhash64("role", "text")
    rows = turns.select("conv_id", "file", "row", F.octet_length("text").cast("long").alias("bytes"), h.alias("h"), "turn", "role")
    order = ["conv_id", "turn", "role", "h"]
    sorted_rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kinds = "conv_id long, file long, row long, bytes long, range int, pos long, fp long, before long, end boolean"
    local = written(sorted_rows.select("conv_id", "file", "row", "bytes", "h").mapInArrow(_scan_range(bits), kinds), "scans")
    carried = _carried(local.where("end").select("range", "conv_id", "pos", "fp").collect())  # a row for each task
    local = local.where("not end")
    table = local_table(spark, carried or [(-1, 0, 0, 0)], "range int, conv_id long, had long, from long")
    met = local.join(F.broadcast(table), ["range", "conv_id"], "left").withColumns({"had": F.coalesce("had", F.lit(0)), "from": F.coalesce("from", F.lit(0))})
    return met.select("conv_id", "file", "row", "bytes", (F.col("had") + F.col("pos")).alias("pos"), advance("from", "pos", "fp").alias("fp"), advance("from", F.col("pos") - 1, "before").alias("before"))


def _prefixes(turns: DataFrame, fork_from: Column | None, fork_at: Column | None, bits: int) -> DataFrame:
    """(conv_id, depth, fp, before, file, row, bytes, ends, path, path_before): a row for
    each prefix of each conversation, the empty one included."""
    scanned = written(_fingerprints(turns, bits).select("conv_id", "file", "row", "bytes", "pos", "fp", "before"), "prefixes")
    early = F.when(F.col("pos") <= MOST_FORKED, F.struct("pos", "fp", "before", "file", "row", "bytes"))
    convs = written(scanned.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(early)).alias("first")), "conversations")
    total = scanned.count()
    empty = F.array().cast(convs.schema["first"].dataType)
    asked = convs.select("conv_id", "n", F.col("first").alias("own"), (fork_from if fork_from is not None else F.col("conv_id")).cast("long").alias("other"), F.greatest(F.coalesce((fork_at if fork_at is not None else F.lit(0)).cast("long"), F.lit(0)), F.lit(0)).alias("h"))
    most = asked.agg(F.max("h")).first()[0] or 0
    if most > MOST_FORKED:
        raise ValueError(f"a conversation takes {most} turns from another; {MOST_FORKED} is the most")
    wanted = asked.where("h > 0 and other is not null").groupBy("other").agg(F.count("*").alias("n"))
    others = convs.select(F.col("conv_id").alias("other"), "first").join(wanted, "other")
    met = _by_key(asked.withColumn("other", F.coalesce("other", "conv_id")).withColumn("h", F.when(F.col("other").isNull(), 0).otherwise(F.col("h"))), others, ["other"], convs.count(), "left")
    met = met.withColumn("k", F.least("h", F.coalesce(F.size("first"), F.lit(0))).cast("long"))
    there = F.when(F.col("k") > 0, F.get("first", (F.col("k") - 1).cast("int"))["fp"]).otherwise(0)
    here = F.when((F.col("h") > 0) & (F.col("n") >= F.col("h")), F.get("own", (F.col("h") - 1).cast("int"))["fp"]).otherwise(0)
    heads = met.select("conv_id", "n", "h", "k", F.pmod(there - here, F.lit(P)).alias("gap"), F.slice(F.coalesce("first", empty), F.lit(1), F.col("k").cast("int")).alias("first"))
    heads = written(heads, "heads")
    none = F.lit(None).cast("long")
    roots = heads.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), none.alias("before"), none.alias("file"), none.alias("row"), F.lit(0).cast("long").alias("bytes"), ((F.col("k") == 0) & (F.col("n") <= F.col("h"))).alias("ends"))
    taken = heads.select("conv_id", "n", "h", "k", F.explode("first").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.fp", "t.before", "t.file", "t.row", "t.bytes", ((F.col("t.pos") == F.col("k")) & (F.col("n") <= F.col("h"))).alias("ends"))
    facts = heads.select("conv_id", "n", "h", "k", "gap")
    met = scanned.join(facts, "conv_id") if total <= FEW_ROWS else lookup(scanned, facts.withColumn("m", F.col("n")), ["conv_id"], total=total, count="m", how="inner")
    own = met.where("pos > h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), advance("gap", F.col("pos") - F.col("h"), "fp").alias("fp"), advance("gap", F.col("pos") - 1 - F.col("h"), "before").alias("before"), "file", "row", "bytes", (F.col("pos") == F.col("n")).alias("ends"))
    rows = roots.unionByName(taken).unionByName(own)
    out = written(rows.withColumns({"path": F.lit(""), "path_before": F.lit("")}), "rebuilt")
    discard(scanned, convs, heads)
    return out


KEY = ["depth", "fp", "path"]


def _by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of unique keys with `n`, how many rows have the key."""
    return rows.join(table.drop("n"), keys, how) if total <= FEW_ROWS else lookup(rows, table, keys, total=total, how=how)


def _unlike(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of turns, (file, row) and (to_file, to_row), those that differ in role or
    text. A turn that many are compared with is copied to as many tasks."""
    spark = turns.sparkSession
    there = pairs.groupBy("to_file", "to_row").count()
    total = pairs.count()
    share = max(total // partitions(spark), 1)
    copies = written(there.select("to_file", "to_row", F.col("count").alias("n"), F.ceil(F.col("count") / share).cast("int").alias("copies")), "copies")
    salted = _by_key(pairs, copies, ["to_file", "to_row"], total).withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.col("copies")).cast("int"))
    texts = turns.select("file", "row", "role", "text")
    left = salted.join(texts, ["file", "row"])
    right = texts.select(F.col("file").alias("to_file"), F.col("row").alias("to_row"), F.col("role").alias("to_role"), F.col("text").alias("to_text")).join(copies.select("to_file", "to_row", "copies"), ["to_file", "to_row"])
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = left.join(right, ["to_file", "to_row", "salt"])
    return met.where((F.col("role") != F.col("to_role")) | (F.col("text") != F.col("to_text"))).select("file", "row", "to_file", "to_row")


def _verified(turns: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes and their nodes, once no member's turn differs from that of its node's
    representative. A member that differs goes, with its longer prefixes, to nodes of a
    path of their own; of a node's such members the smallest represents them next."""
    while True:
        total = rows.count()
        groups = written(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")), "groups")
        reps = rows.join(groups.select(*KEY, F.col("rep").alias("conv_id"), "n"), [*KEY, "conv_id"])
        nodes = written(reps.select(*KEY, F.col("conv_id").alias("rep"), "n", "bytes", "before", "path_before", "file", "row"), "nodes")
        discard(groups)
        shared = nodes.where("n > 1 and depth > 0").select(*KEY, "n", "rep", F.col("file").alias("to_file"), F.col("row").alias("to_row"))
        met = _by_key(rows.where("depth > 0").select(*KEY, "conv_id", "file", "row"), shared, KEY, total)
        asked = written(met.where("file <> to_file or row <> to_row"), "asked")
        unlike = written(_unlike(turns, asked.select("file", "row", "to_file", "to_row").distinct()), "unlike")
        if unlike.isEmpty():
            discard(asked, unlike)
            return rows, nodes
        wrong = asked.join(unlike, ["file", "row", "to_file", "to_row"]).select(*KEY, "conv_id")
        first = wrong.groupBy("conv_id").agg(F.min(F.struct("depth", "fp", "path")).alias("at"))
        named = first.groupBy("at").agg(F.min("conv_id").alias("to"))
        moved = first.join(named, "at").select("conv_id", F.col("at.depth").alias("from"), F.concat(F.lit("/"), F.col("at.depth"), F.lit(":"), F.col("to")).alias("step"))
        met = rows.join(moved, "conv_id", "left")
        longer = lambda c, d: F.when(d >= F.col("from"), F.concat(c, "step")).otherwise(F.col(c)).alias(c)
        last, rows = rows, written(met.select(*(c for c in rows.columns if not c.startswith("path")), longer("path", F.col("depth")), longer("path_before", F.col("depth") - 1)), "rebuilt")
        discard(last, nodes, asked, unlike)


def _ends(rows: DataFrame, chunk: int) -> DataFrame:
    """(depth, fp, path, ends_sha256) of the nodes at which conversations end: the digest of
    their numbers in order. Numbers are joined in ranges, and a node's joined pieces are
    hashed one after the other, so nothing is gathered."""
    spark = rows.sparkSession
    ends = rows.where("ends").select(*KEY, "conv_id")
    order = [*KEY, "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, ids, size = None, None, [], 0
        made: list[tuple] = []
        for b in batches:
            for *k, c in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if k != key or len(ids) >= chunk:
                    if ids:
                        made.append((*key, at, ",".join(ids)))
                        size += len(made[-1][-1])
                    key, at, ids = k, c, []
                ids.append(str(c))
                if size > 1 << 22 or len(made) >= 10_000:
                    yield batch(made)
                    made, size = [], 0
        if ids:
            made.append((*key, at, ",".join(ids)))
        if made:
            yield batch(made)

    schema = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("ids", pa.string())])
    batch = lambda made: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
    pieces = ends.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, fp long, path string, at long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        made: list[tuple] = []
        for b in batches:
            for *k, _, ids in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    made.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            if made:
                yield done(made)
                made = []
        if key is not None:
            yield done([(*key, sha.hexdigest())])

    out = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("path", pa.string()), ("ends_sha256", pa.string())])
    done = lambda made: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
    return pieces.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "at").mapInArrow(digest, "depth long, fp long, path string, ends_sha256 string")


def _rolled_up(nodes: DataFrame, *, max_rounds: int = 64) -> DataFrame:
    """(id, leaves, saved): sums over the subtrees of (id, parent, leaves, saved). In a round
    each node hands what it has to the ancestor that is twice as far as in the last one,
    so there are as many rounds as the depth has bits; sums and the steps of nodes below
    one ancestor meet by partial aggregates."""
    now = written(nodes, "rollup")
    for _ in range(max_rounds):
        below = now.where("parent is not null")
        gains = written(below.groupBy("parent").agg(F.count("*").alias("n"), F.sum("leaves").alias("more"), F.sum("saved").alias("spared")), "gains")
        total = gains.agg(F.sum("n")).first()[0]
        if not total:
            discard(gains)
            return now
        above = gains.select("parent", "n").join(now.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent")
        steps = _by_key(below.select("id", "parent"), above, ["parent"], total).select("id", "next")
        met = now.join(gains.select(F.col("parent").alias("id"), "more", "spared"), "id", "left").join(steps, "id", "left")
        grown = met.select("id", F.col("next").alias("parent"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("spared", F.lit(0))).alias("saved"))
        last, now = now, written(grown, "rollup")
        discard(last, gains)
    raise RuntimeError(f"the trie is deeper than {max_rounds} doublings")


def prefix_trie(conversations: DataFrame, *, fork_from: Column | None = None, fork_at: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", hash_bits: int = 61, chunk: int = 65_536) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, text_file, text_row): a row for each distinct prefix of the
    conversations.

    A conversation is its turns in order of `turn`, nulls first; turns of one number go by
    role, then by the text's hash. Null roles and texts count as empty. With fork_from and
    fork_at (Columns of conv_id) a conversation's first fork_at turns are replaced by those
    of conversation fork_from, as many as that has; at most MOST_FORKED. A node is named by
    its depth (0: the root) and its smallest member, conv_id; members are the conversations
    that begin with it, n_leaves and saved_tokens sum over its subtree, itself included:
    nodes without children, and (n_convs - 1) times the bytes of the last text.
    ends_sha256: digest of the numbers of the conversations that end here. text_file and
    text_row: where the last turn is stored (see `placed`); null for the root.

    Rows without a conv_id are left out; repeated rows are turns of their own; long
    conversations and texts are like others: a conversation is dealt to tasks by turn, texts
    are hashed where they are read, and only those of turns that have to be compared are
    shuffled. An empty table has no members, so no node. Other columns are not read.
    hash_bits: turns' hashes are cut to that many bits (few only to test how collisions
    are split).
    """
    spark = conversations.sparkSession
    small_batches(spark, 10_000)
    file, row = free_names(conversations, "file", "row")
    empty = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text")))
    turns = placed(conversations, file, row).select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), *empty, F.col(file).alias("file"), F.col(row).alias("row")).where("conv_id is not null")
    rows, nodes = _verified(turns, _prefixes(turns, fork_from, fork_at, hash_bits))
    numbered = written(nodes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    total = numbered.count()
    up = numbered.where("depth > 0").select("id", "n", (F.col("depth") - 1).alias("depth"), F.col("before").alias("fp"), F.col("path_before").alias("path"))
    families = written(up.groupBy(*KEY).agg(F.count("*").alias("n_children"), F.sum((F.col("n") == 1).cast("long")).alias("alone")), "families")
    parents = numbered.select(*KEY, F.col("id").alias("parent"), F.col("rep").alias("parent_conv_id")).join(families.select(*KEY, F.col("n_children").alias("n")), KEY)
    child = written(_by_key(up.select("id", *KEY), parents, KEY, total).select("id", "parent", "parent_conv_id"), "children")
    whole = numbered.join(families, KEY, "left").join(child, "id", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "alone": F.coalesce("alone", F.lit(0))})
    whole = written(whole, "family")
    own = F.when(F.col("n_children") == 0, 1).otherwise(F.col("alone")).cast("long")
    summed = _rolled_up(whole.where("n > 1 or depth = 0").select("id", "parent", own.alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved")))
    found = whole.join(summed.select("id", "leaves", "saved"), "id", "left").join(_ends(rows, chunk), KEY, "left")
    return found.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.col("file").alias("text_file"), F.col("row").alias("text_row"),
    )

