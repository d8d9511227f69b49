"""SimHash fingerprints of whole texts and exact components of near fingerprints.

Links are found by the generalised pigeonhole principle: bits that go together are
grouped into partitions, and a partition i gets a threshold t[i]; two fingerprints
within `distance` bits agree up to t[i] bits in some partition if the sum of t[i] + 1
exceeds `distance`. Thresholds are even: two values within 2 r bits meet in a value
within r bits of both, so each fingerprint is dealt to all values within r of its own.
How many partitions, and which thresholds, is chosen by dynamic programming on the
estimated rows and candidates. Fingerprints that meet are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import lookup
from ..operators.storage import discard
from ..operators.tables import FEW_ROWS, at_places, free_names
from .common import partitions, placed, release_memos, small_batches, written

BITS = 64
#: Texts whose shingle hashes a worker holds at a time.
TEXTS_AT_ONCE = 128
#: _SPREAD[b]: bit j of the byte b as the byte j of a word, to count bits by sums.
_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)) << np.arange(0, 64, 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> list[int]:
    """XXH64 of the space-joined shingles of `width` words of the text with A-Z in
    lower case, repeats included; the whole sequence if it has fewer words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII white space, ASCII case
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[width:], strict=False)]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """A 64-bit fingerprint for each list of hashes: a bit is 1 if over half of the
    hashes have it; no hashes: zero."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.asarray(h, np.uint64) for h in hashes if len(h)]).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(sizes[full])
    starts = ends - sizes[full]
    # pieces of at most 255 hashes, so that sums fit in bytes
    per = -(-sizes[full] // 255)
    first = np.cumsum(per) - per
    cuts = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[flat[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out


def prints(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Two fingerprints of each list of hashes, the second of the hashes remixed."""
    mixed = [((x := h ^ np.uint64(43)) ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD) for h in hashes]
    return [fingerprints(hashes), fingerprints([m ^ m >> np.uint64(33) for m in mixed])]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def add_fingerprints(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), a row for each row; fp is the fingerprint as a signed long. A null
    text has no words, and so fingerprint zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                fp = fingerprints([shingle_hashes(t, width) for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints, and for each two bits how many have both: sums over all
    rows, 64 x 64 numbers whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])

    both = np.zeros(BITS * BITS)
    for r in fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[r.at] = r.n
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near equal size, each grown from the most correlated
    free bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        a, b = max(combinations(free, 2), key=lambda x: (corr[x], -x[0], -x[1])) if len(free) > 1 else (free[0], free[0])
        own = sorted({a, b})[:size]
        while len(own) < size:
            own.append(max((x for x in free if x not in own), key=lambda x: (corr[x, own].sum(), -x)))
        groups.append(sorted(own))
        free = [x for x in free if x not in own]
    return groups


def plan(n: int, both: np.ndarray, distance: int, *, pair_cost: float = 0.02, most: int = 8) -> list[tuple[list[int], int]]:
    """(bits, radius) of each partition in use. For every number of partitions, dynamic
    programming over partitions and the pigeonholes still needed finds the radii of
    least cost: rows dealt out, and candidate pairs (as they follow from the share of
    ones of each bit) at pair_cost of a row."""
    p = np.diag(both) / max(n, 1)
    n = max(n, 1000)  # an empty or tiny table is dealt out like a small one
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, min(most, distance + 1) + 1):
        groups = group_bits(n, both, parts)
        state = {0: (0.0, [])}  # pigeonholes that are filled: cost and choice
        for bits in groups:
            chance = np.ones(1)
            for q in differ[bits]:
                chance = np.convolve(chance, [1 - q, q])
            costs = {-1: 0.0}
            for r in range(distance // 2 + 1):
                rows = sum(comb(len(bits), k) for k in range(r + 1))
                costs[r] = n * rows + pair_cost * n * n / 2 * chance[: 2 * r + 1].sum()
            new: dict = {}
            for filled, (cost, chosen) in state.items():
                for r, c in costs.items():
                    to = min(filled + (2 * r + 1 if r >= 0 else 0), distance + 1)
                    if to not in new or cost + c < new[to][0]:
                        new[to] = (cost + c, [*chosen, (bits, r)])
            state = new
        cost, chosen = state.get(distance + 1, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [x for x in chosen if x[1] >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball(fp: str, bits: list[int], radius: int, part: int) -> list:
    """Expressions of (part, key): the masked fingerprint and all within `radius` bits."""
    mask = sum(1 << b for b in bits)
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [F.struct(F.lit(part).alias("part"), F.col(fp).bitwiseXOR(F.lit(_signed(f))).bitwiseAND(F.lit(_signed(mask))).alias("key")) for f in flips]


def _forest(words: list[np.ndarray], nodes: np.ndarray, limits: list[int]) -> list[tuple[int, int]]:
    """(node, root) for the members of each component of two at least: a search that
    compares each reached member with those not reached yet."""
    rest, found = np.arange(len(nodes)), []
    while len(rest):
        queue, own, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            i, apart, near = queue.pop(), 0, True
            for w, limit in zip(words, limits, strict=True):
                apart = apart + np.bitwise_count(w[rest] ^ w[i]).astype(np.int16)
                near = near & (apart <= limit)
            if near.any():
                queue.extend(rest[near])
                own.extend(rest[near])
                rest = rest[~near]
        if len(own) > 1:
            root = nodes[own].min()
            found += [(x, root) for x in nodes[own] if x != root]
    return found


def links_in(words: list[np.ndarray], nodes: np.ndarray, limits: list[int]) -> list[tuple[int, int]]:
    """Edges that join the components of one bucket's members. words: the members'
    fingerprints, 64 bits each; linked are two members if for every i their first i + 1
    words differ in no more than limits[i] bits. In a bucket of few near pairs these are
    the edges; else each member gets one edge, to its component's root."""
    if len(nodes) > 2048:
        return _forest(words, nodes, limits)
    near = np.bitwise_count(words[0][:, None] ^ words[0]) <= limits[0]
    hits = int(near.sum()) - len(nodes)
    if not hits:
        return []
    if hits > 8 * len(nodes):
        return _forest(words, nodes, limits)
    i, j = np.nonzero(np.triu(near, 1))
    apart, keep = 0, np.ones(len(i), bool)
    for w, limit in zip(words, limits, strict=True):
        apart = apart + np.bitwise_count(w[i] ^ w[j]).astype(np.int16)
        keep &= apart <= limit
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(nodes[i[keep]].tolist(), nodes[j[keep]].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _edges(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distinct edges between different nodes."""
    keep = u != v
    return np.unique(np.stack([u[keep], v[keep]], axis=1), axis=0)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[list[np.ndarray]], list[np.ndarray]]]:
    """Of rows (part, key, node, words ...) sorted by part and key, batch by batch: the
    whole runs of two to `most` members that ended, as columns, and the nodes of pieces
    of longer runs. Of an unfinished run no more than `most` members and a batch are
    held."""
    held, over = None, None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        whole: list[list[np.ndarray]] = []
        hot: list[np.ndarray] = []
        if over is not None:
            n = int(((rows[0] == over[0]) & (rows[1] == over[1])).sum())  # sorted: they come first
            hot.append(rows[2][:n])
            rows = [x[n:] for x in rows]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[2]):
            part, key, node = rows[:3]
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(node)]])
            size = np.diff(bounds)
            for i in np.flatnonzero(size[:-1] > 1):
                a, b = bounds[i], bounds[i + 1]
                if size[i] <= most:
                    whole.append([x[a:b] for x in rows[2:]])
                else:
                    hot.append(node[a:b])
            a = bounds[-2]
            held, over = [x[a:] for x in rows], None
            if size[-1] > most:
                hot.append(node[a:])
                held, over = None, (part[a], key[a])
        yield whole, hot
    if held is not None and len(held[2]) > 1:
        yield [held[2:]], []


def _search(dealt: DataFrame, limits: list[int], most: int) -> DataFrame:
    """(u, v) from rows (part, key, node, words ...): edges of all buckets, and (node,
    node) for members of buckets of over `most`."""
    count = partitions(dealt.sparkSession)
    sorted_keys = dealt.repartition(count, "part", "key").sortWithinPartitions("part", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for whole, hot in _runs(batches, most):
            found = [x for node, *words in whole for x in links_in([w.view(np.uint64) for w in words], node, limits)]
            linked = np.array(found, np.int64).reshape(-1, 2)
            own = np.unique(np.concatenate([np.zeros(0, np.int64), *hot]))
            edges = np.concatenate([_edges(linked[:, 0], linked[:, 1]), np.stack([own, own], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    return sorted_keys.mapInArrow(search, "u long, v long")


def near_edges(fps: DataFrame, distance: int, *, most: int = 8192) -> DataFrame:
    """(u, v): edges that join exactly the components of the distinct fingerprints in
    fps (column fp) under links of up to `distance` bits; not all links.

    A bucket of up to `most` fingerprints is searched within one task, which holds no
    more than that. Fingerprints of larger buckets are dealt once more, to all values
    within half the distance of them in all 64 bits: what meets there is linked without
    a comparison, so the work grows with the number of fingerprints and not with its
    square, and no bucket is held in memory.
    """
    n, both = bit_counts(fps)
    chosen = plan(n, both, distance)
    keys = [k for i, (bits, radius) in enumerate(chosen) for k in ball("fp", bits, radius, i)]
    count = partitions(fps.sparkSession)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.col("k.part"), F.col("k.key"), "fp", F.col("fp").alias("word"))
    found = written(_search(dealt, [distance], most), "near")
    hot = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    edges = found.where("u <> v")
    if hot.isEmpty():
        return edges
    near, far = distance // 2, distance - distance // 2
    flips = [(r > near, sum(1 << b for b in c)) for r in range(far + 1) for c in combinations(range(BITS), r)]
    masks, outer = np.array([f for _, f in flips], np.uint64), np.array([x for x, _ in flips])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for piece in np.array_split(fp, max(1, len(fp) * len(masks) >> 19)):
                key = (piece[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(outer, len(piece))), pa.array(np.repeat(piece, len(masks)).view(np.int64))], ["key", "outer", "fp"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root, inner = None, np.int64(0), False  # key, its first fingerprint and whether that is an inner one
        for batch in batches:
            key, ring, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(fp)), -1))
            roots = np.where(first >= 0, fp[np.maximum(first, 0)], root)
            good = np.where(first >= 0, ~ring[np.maximum(first, 0)], inner)
            last, root, inner = key[-1], roots[-1], good[-1]
            edges = _edges(fp[good], roots[good])
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    met = hot.repartition(count, "fp").mapInArrow(spread, "key long, outer boolean, fp long").repartition(count, "key").sortWithinPartitions("key", "outer", "fp")
    return edges.union(met.mapInArrow(stars, "u long, v long").distinct())


def simhash_components(docs: DataFrame, *, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    fp is the SimHash of the whole text (see shingle_hashes), component_id the smallest
    doc_id that is reachable over links of at most `distance` differing bits, itself
    included. Texts without words, null ones too, have fingerprint zero and are linked
    like any other. Repeated doc_ids and equal rows stay, each with its result; a null
    doc_id gets its component's smallest doc_id, null if all are null. An empty table
    gives an empty result; other columns are not read. A very long text is read whole;
    a worker holds its shingles' hashes, 8 bytes a word. Equal fingerprints are counted
    once before they are dealt out, and joined by lookup, so copies don't meet in one task.
    """
    prints = written(add_fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "fingerprints")
    total = prints.count()
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct", total)
    labels = written(connected_components(near_edges(distinct, distance), "u", "v"), "labels", distinct.count())
    linked = labels.join(distinct, F.col("node") == F.col("fp"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = lookup(labels, written(least, "least"), ["component"], total=labels.count()).select(F.col("node").alias("fp"), "component_id")
    by_print = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    by_print = written(by_print, "by_print", total)
    discard(distinct, labels)
    return lookup(prints, by_print, ["fp"], total=total).select("doc_id", "fp", "component_id")


def common_shingles(docs: DataFrame, text_col: str, width: int, hot_key: int, *, texts: int = 10_000, share: float = 0.01, least: int = 5, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that at least `least` sampled texts hold, the rarest first, the
    `most` most frequent ones; and those of them that about hot_key texts of all hold. About
    `texts` texts are sampled, or that share of all if more. Which shingles are known as
    common decides where texts meet, not whether they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                sets = [shingle_set(t, width) for t in batch.column(0).slice(at, TEXTS_AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    drawn = min(1.0, max(texts / max(docs.count(), 1), share))
    some = docs.select(F.col(f"`{text_col}`")).sample(drawn, seed=7)
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "h").limit(most).collect()[::-1]
    hashes, n = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    return hashes, hashes[n >= hot_key * drawn]


def rare_shingles(hashes: np.ndarray, common: np.ndarray, order: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's first hashes that two sets of at least the similarity share one:
    both share at least that part of their own. First are those not in common (by value),
    then common ones by their place in it; order sorts common by value."""
    take = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if not len(common) or not take:
        return hashes[:take]
    at = np.searchsorted(common, hashes, sorter=order)
    place = order[np.minimum(at, len(order) - 1)]
    known = common[place] == hashes
    cold = hashes[~known][:take]
    return np.concatenate([cold, common[np.sort(place[known])[: take - len(cold)]]])


def _stars(edges: np.ndarray) -> np.ndarray:
    """One edge, to its component's least node, for each other node of the edges."""
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        a, b = label[u], label[v]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
    return np.stack([nodes, nodes[label]], axis=1)[label != np.arange(len(nodes))]


#: Bits of so few shingles deviate too far to tell similar sets, which are counted at once.
SMALL_SET = 30


def _meetings(rows: list[np.ndarray], similarity: float, radius: int, few: int = 32) -> np.ndarray:
    """Edges that join the members (key, node, fp, word, n) of one key that could be
    similar: by size, and by 128 bits unless one is a small set. rows: whole runs of equal
    keys."""
    cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
    bounds = np.concatenate([[0], cuts, [len(rows[0])]])
    size = np.diff(bounds)
    found = [np.zeros((0, 2), np.int64)]
    for i in np.flatnonzero(size > few):
        _, node, fp, word, n = (x[bounds[i] : bounds[i + 1]] for x in rows)
        small = np.flatnonzero(n < SMALL_SET)
        small = small[np.argsort(n[small], kind="stable")]
        close = n[small[:-1]] >= similarity * n[small[1:]] - 1e-9
        found.append(np.stack([node[small[:-1]], node[small[1:]]], axis=1)[close])
        found.append(np.array(_forest([fp.view(np.uint64), word.view(np.uint64)], node, [BITS, radius]), np.int64).reshape(-1, 2))
    own = np.repeat((size > 1) & (size <= few), size)
    key, node, fp, word, n = (x[own] for x in rows)
    for d in range(1, few):
        i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else key[:0]
        if not len(i):
            break
        apart = np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)).astype(np.int16) + np.bitwise_count((word[i] ^ word[i + d]).view(np.uint64))
        least = np.minimum(n[i], n[i + d])
        i = i[((apart <= radius) | (least < SMALL_SET)) & (least >= similarity * np.maximum(n[i], n[i + d]) - 1e-9)]
        found.append(np.stack([node[i], node[i + d]], axis=1))
    return _stars(np.concatenate(found))


#: So many keys of a bucket, of 16 bytes, are met at a time.
KEYS_AT_ONCE = 500_000


def shared_keys(lists: DataFrame, total: int) -> DataFrame:
    """(key, node) of the rows (node, keys: arrays of longs, distinct in a row) whose key
    another row has too. total: how many keys there are.

    Most rare shingles are in one text alone, so nothing but the keys and nodes goes to
    where equal keys meet, and that in packs of 8 and 4 bytes: a pack for each bucket of
    keys and batch, so the bytes a key don't grow with the number of partitions."""
    count = partitions(lists.sparkSession)
    buckets = max(count, -(-total // KEYS_AT_ONCE))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            size = keys.value_lengths().to_numpy(zero_copy_only=False)
            key, node = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(node, size)
            if not len(key):
                continue
            bucket, far = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64), node >> 32
            order = np.lexsort((far, bucket))
            key, node, bucket, far = key[order], node[order], bucket[order], far[order]
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (far[1:] != far[:-1])]))
            ends = [*starts[1:], len(key)]
            near = (node & 0xFFFFFFFF).astype(np.uint32)
            packs = [[x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (key, near)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(far[starts]), *(pa.array(x, pa.binary()) for x in packs)], ["bucket", "far", "keys", "nodes"])

    def met(held: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(k, np.int64) for _, k, _ in held])
        node = np.concatenate([(far << 32) | np.frombuffer(n, np.uint32).astype(np.int64) for far, _, n in held])
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = key[1:] == key[:-1]
        own = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(node[own])], ["key", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        last, held = None, []
        for batch in batches:
            for bucket, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and held:
                    yield met(held)
                    held = []
                last = bucket
                held.append(own)
        if held:
            yield met(held)

    packs = lists.mapInArrow(pack, "bucket long, far long, keys binary, nodes binary")
    return packs.repartition(count, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, node long")


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the others shares with own; none is empty."""
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *(len(x) for x in others[:-1])]))


def similar_groups(sets: list[np.ndarray], words: list[np.ndarray], similarity: float, radius: int) -> np.ndarray:
    """For each set the place of the first one reachable over links of at least the exact
    similarity (shared hashes over all hashes of both) within `radius` of the words' bits, which small sets needn't be."""
    root, size = np.arange(len(sets)), np.array([len(x) for x in sets])
    rest = root.copy()
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            apart = sum(np.bitwise_count(w[rest] ^ w[i]).astype(np.int16) for w in words)
            least = np.minimum(size[rest], size[i])
            fits = least >= similarity * np.maximum(size[rest], size[i]) - 1e-9
            near = np.flatnonzero(((apart <= radius) | (least < SMALL_SET)) & fits)
            gone = []
            for at in range(0, len(near), 1024):
                some = near[at : at + 1024]
                both = _overlaps(sets[i], [sets[j] for j in rest[some]])
                gone.append(some[both >= similarity * (size[i] + size[rest[some]] - both) - 1e-9])
            if gone and len(reached := np.concatenate(gone)):
                root[rest[reached]] = first
                queue.extend(rest[reached])
                rest = np.delete(rest, reached)
    return root


def one_of_each(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, distance: int = 4, radius: int = 46, text_col: str = "text", group_size: int = 4_000_000, hot_key: int = 20_000) -> DataFrame:
    """The rows of docs, all columns as they are, of which no earlier one is a near copy:
    one row of each group of near copies stays.

    Groups are the components of links between texts whose sets of shingles of five words
    have at least the similarity, counted exactly: shared shingles over all shingles of
    both. Texts with equal sets are one; null texts and texts without words have the empty
    set and form a group. Which row stays is the first in the order in which docs is first
    read. An empty table gives an empty result. docs is read several times; rows are
    numbered once, and the numbers stored with the rows' places in the stored files (see
    placed), by which the copies are removed. Texts of a stored table aren't copied but
    for those that may have near copies, which are shuffled once. A very long text is read
    whole: a worker holds its shingles' hashes, 8 bytes a word.

    Candidates are found by SimHash first, as in simhash_components: fingerprints of 64
    bits that differ in up to `distance` meet by the generalised pigeonhole principle. At a
    similarity of 0.8 most differ in more, and a pigeonhole search so wide compares all
    pairs; but two such sets share one of their rarest shingles (see rare_shingles), so
    the rest of the texts meets there, which loses none. What meets and differs in up to `radius` of 128
    bits of SimHash, or has under SMALL_SET shingles, joins a candidate group; the radius is
    far beyond what a similarity of 0.8 differs in (19, deviation 4; the chance of more than
    46 is below one in a billion from 30 shingles on) and keeps texts apart that share a
    common passage alone (64, deviation 6). Shingles that a sample finds in about hot_key texts or more
    aren't gathered: all their texts join one group. Groups are then split exactly by
    their shingles (see split_groups), group_size shingles at most in a task.
    """
    import xxhash

    spark = docs.sparkSession
    small_batches(spark)
    count = partitions(spark)
    file, row = free_names(docs, "file", "row")
    stored = placed(docs, file, row)
    common, hot = common_shingles(stored, text_col, width, hot_key)
    order = np.argsort(common)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                sets = [shingle_set(t, width) for t in some.column(1).to_pylist()]
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(x.tobytes()), 1 << 64) for x in sets], np.uint64).view(np.int64)
                rare = [rare_shingles(x, common, order, similarity) for x in sets]
                known = [np.isin(x, hot) for x in rare] if len(hot) else [np.zeros(len(x), bool) for x in rare]
                sizes = pa.array([len(x) for x in sets], pa.int32())
                columns = [some.column(0), *(pa.array(x.view(np.int64)) for x in prints(sets)), sizes, pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists([x[~k] for x, k in zip(rare, known, strict=True)]), lists([x[k] for x, k in zip(rare, known, strict=True)]), some.column(2), some.column(3)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "word", "n", "digest_a", "digest_b", "rare", "hot", file, row])

    texts = stored.select(F.monotonically_increasing_id().alias("node"), F.col(f"`{text_col}`"), file, row)
    rows = written(texts.mapInArrow(describe, f"node long, fp long, word long, n int, digest_a long, digest_b long, rare array<long>, hot array<long>, {file} long, {row} long"), "prints")
    total = rows.count()
    distinct = written(rows.groupBy("digest_a", "digest_b").agg(F.min("node").alias("node")).select("node"), "distinct", total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        held: list[list[np.ndarray]] = []
        size, enough = 0, 50_000
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            size += batch.num_rows
            if size < enough:
                continue
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(joined[0], joined[0][-1]))  # the last run may go on
            held, size = [[x[cut:] for x in joined]], len(joined[0]) - cut
            enough = max(50_000, 2 * size)
            if cut:
                yield edges_of([x[:cut] for x in joined])
        if size:
            yield edges_of([np.concatenate(x) for x in zip(*held, strict=True)])

    def edges_of(runs: list[np.ndarray]) -> pa.RecordBatch:
        edges = _meetings(runs, similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    part, at_ = free_names(rows, "part", "at")  # a node's file and its number in it
    split_node = lambda df: df.withColumns({part: F.shiftright("node", 33), at_: F.col("node").bitwiseAND((1 << 33) - 1)})
    own = at_places(split_node(rows), split_node(distinct), part, at_, keep=True).drop(part, at_)
    keys = written(shared_keys(own.select("node", "rare"), own.agg(F.sum(F.size("rare"))).first()[0] or 0), "shared_keys")
    dealt = keys.join(own.select("node", "fp", "word", "n"), "node").select("key", "node", "fp", "word", "n")
    met = dealt.repartition(count, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")
    firsts = written(own.groupBy("fp").agg(F.min("node").alias("first")), "firsts", total)
    at = lambda end: firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
    near_bits = near_edges(firsts, distance).join(at("u"), "u").join(at("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    met = met.union(near_bits).union(own.join(firsts, "fp").where("node <> first").select("node", "first"))
    if len(hot):  # a hot shingle is a node itself, below all texts
        key = F.col("key")
        met = met.union(own.select("node", F.explode("hot").alias("key")).select("node", F.when(key < 0, key).otherwise(-1 - key)))
    labels = connected_components(met, "u", "v")
    members = written(rows.join(labels, "node").select("component", "node", "fp", "word", "n", file, row), "members", total)
    source = stored.select(F.col(f"`{text_col}`").alias("text_"), F.col(file).alias("file_"), F.col(row).alias("row_"))
    near = split_groups(source, members.withColumnsRenamed({file: "file_", row: "row_"}), width=width, similarity=similarity, radius=radius, group_size=group_size)
    stays = distinct.join(near, "node", "left_anti")
    goes = written(rows.join(stays, "node", "left_anti").select(file, row), "copies", total)
    discard(near)
    discard(rows, distinct, members, firsts, keys)
    return at_places(stored, goes, file, row, keep=False).select(*(F.col(f"`{c}`") for c in docs.columns))


def _sets(batches: Iterator[pa.RecordBatch], keys: int, width: int) -> Iterator[tuple[tuple, tuple]]:
    """(key, (other columns ..., shingle set)) of rows whose last column is the text."""
    for batch in batches:
        known = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1)), strict=True)
        for i, r in enumerate(known):
            yield r[:keys], (*r[keys:], shingle_set(batch.column(batch.num_columns - 1)[i].as_py(), width))


def split_groups(source: DataFrame, members: DataFrame, *, width: int, similarity: float, radius: int, group_size: int) -> DataFrame:
    """(node) of members (component, node, fp, word, n shingles, file_, row_) whose class has
    a smaller node: classes are the components of a group's links of exact similarity.
    source has the texts by (file_, row_).

    A group of up to group_size shingles is split in one task. A larger one is dealt into
    pieces of about half that size, and the first nodes of the pieces' classes are dealt
    anew, until one piece holds them or their number falls no more; a group of copies
    shrinks to one class so. Where several classes are left, every member outside the
    largest meets all members of other classes, piece by piece, which finds all links:
    no task holds more than half of group_size and one text.
    """
    spark = members.sparkSession
    count, half = partitions(spark), max(group_size // 2, 1)

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= FEW_ROWS else df  # 60 bytes a row

    def texts_of(pieces: DataFrame) -> DataFrame:
        """source, or if the pieces are too many to be sent to it, no more than their texts."""
        return source if pieces.count() <= FEW_ROWS else at_places(source, pieces, "file_", "row_", keep=True)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        group, held = None, []

        def links() -> pa.RecordBatch:
            nodes, fps, words, sets = zip(*held, strict=True)
            root = similar_groups(list(sets), [np.array(x, np.int64).view(np.uint64) for x in (fps, words)], similarity, radius)
            nodes = np.array(nodes, np.int64)
            goes = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(nodes[goes]), pa.array(nodes[root[goes]])], ["node", "leader"])

        for key, member in _sets(batches, 2, width):
            if key != group and held:
                yield links()
                held = []
            group = key
            held.append(member)
        if held:
            yield links()

    def split(pieces: DataFrame, name: str) -> DataFrame:
        """(node, leader) from members with a column piece."""
        where = sized(pieces.select("component", "piece", "node", "fp", "word", "file_", "row_"))
        found = texts_of(pieces).join(where, ["file_", "row_"]).select("component", "piece", "node", "fp", "word", "text_")
        near = found.repartition(count, "component", "piece").sortWithinPartitions("component", "piece", "node").mapInArrow(classes, "node long, leader long")
        return written(near, name, pieces.count())

    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("component").agg(F.sum(F.greatest("n", F.lit(1))).alias("size"))

    piece = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), parts)
    heavy = written(sizes(members).where(F.col("size") > group_size), "heavy", members.count())
    if heavy.isEmpty():
        return split(members.withColumn("piece", F.lit(0).cast("long")), "near").select("node")
    heavy_ids = sized(heavy.select("component"))
    light = split(members.join(heavy_ids, "component", "left_anti").withColumn("piece", F.lit(0).cast("long")), "light")
    left = written(members.join(heavy_ids, "component"), "left", members.count())
    large, linked, n = left, None, left.count()
    for turn in range(100):
        parts = written(sizes(left).withColumn("parts", F.when(F.col("size") > group_size, F.ceil(F.col("size") / half)).otherwise(1)), "parts", n)
        found = split(left.join(sized(parts), "component").withColumn("piece", piece(F.col("parts"), turn)), "links")
        linked = found if linked is None else linked.union(found)
        left = written(left.join(found, "node", "left_anti"), "left", n)
        before, n = n, left.count()
        if n > 0.9 * before or not parts.where("parts > 1").limit(1).count():
            break
    named = connected_components(linked, "node", "leader").withColumnRenamed("component", "label")
    labelled = written(large.join(named, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled", before)
    by_class = labelled.groupBy("component", "label").agg(F.sum(F.greatest("n", F.lit(1))).alias("size"))
    major = by_class.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("major"), F.sum("size").alias("size"), F.max("size").alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    plan = written(major.select("component", "major", F.ceil(F.col("size") / half).alias("pieces"), F.ceil((F.col("size") - F.col("top")) / half).alias("blocks")), "plan", before)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        group: tuple | None = None
        held: list[tuple] = []
        root: dict[int, int] = {}
        found: list[tuple[int, int]] = []
        arrays: list[np.ndarray] = []

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def edges() -> pa.RecordBatch:
            out = np.array(found, np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])

        for key, (role, label, fp, word, own) in _sets(batches, 3, width):
            if key != group:
                yield edges()
                group, held, root, arrays = key, [], {}, []
            if not role:
                held.append((label, fp, word, own))
                continue
            if not held:
                continue
            if not arrays:
                arrays = [np.array([h[i] for h in held], np.int64) for i in range(3)] + [np.array([len(h[3]) for h in held])]
            labels_, fps, words, n_ = arrays
            apart = np.bitwise_count((fps ^ fp).view(np.uint64)).astype(np.int16) + np.bitwise_count((words ^ word).view(np.uint64))
            least = np.minimum(n_, len(own))
            fits = least >= similarity * np.maximum(n_, len(own)) - 1e-9
            for i in np.flatnonzero((labels_ != label) & ((apart <= radius) | (least < SMALL_SET)) & fits):
                a, b = find(int(labels_[i])), find(label)
                if a == b or not len(own):
                    continue
                both = int(_overlaps(own, [held[i][3]])[0])
                if both >= similarity * (len(own) + n_[i] - both) - 1e-9:
                    root[max(a, b)] = min(a, b)
                    found.append((a, b))
        yield edges()

    if not plan.isEmpty():
        upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        met = texts_of(labelled).join(sized(labelled), ["file_", "row_"]).join(sized(plan), "component")
        minors = met.where("label <> major").select("component", piece(F.col("blocks"), -1).alias("block"), F.explode(upto("pieces")).alias("piece"), F.lit(0).alias("role"), "label", "fp", "word", "text_")
        others = met.select("component", F.explode(upto("blocks")).alias("block"), piece(F.col("pieces"), -2).alias("piece"), F.lit(1).alias("role"), "label", "fp", "word", "text_")
        task = ["component", "block", "piece"]
        crossed = minors.unionByName(others).repartition(count, *task).sortWithinPartitions(*task, "role").mapInArrow(cross, "u long, v long")
        linked = linked.union(written(crossed, "crossed"))
        named = connected_components(linked, "node", "leader").withColumnRenamed("component", "label")
    return written(light.select("node").union(named.where("label <> node").select("node")), "near", before)
