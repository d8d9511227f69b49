"""Benchmark decontamination in DataFrame functions alone.

A document's windows of an item's length are compared with the item. Words are runs of
letters and digits in lower case; a text's shingles are its runs of five words, or the
whole sequence if it has fewer. Two texts are as similar as the sum of the least over
that of the greatest counts of their shingles.

Windows of a similarity above zero share a shingle with the item, and of those that
share the same ones, one starts at a shared shingle (or ends with the text). So windows of
an item's length are taken where a shingle of any item of that length is, and enough such
shingles follow for the similarity asked for. Each window gets a SimHash, which finds its
items among all of that length by blocks of bits: more blocks than bits may differ, so
fingerprints within the radius agree in one. What is within the radius is verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .native import signed

WIDTH = 5
BITS = 64


def word_array(text: Column) -> Column:
    """Words of a text; an empty array for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return parts


def _words(rows: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep, and words. Each step is a generator of one row: what it makes is computed
    once, and not again for every use."""
    raw = rows.select(*keep, F.explode(F.array(word_array(F.col(text_col)))).alias("raw"))
    first, last = (F.col("raw")[0] == "").cast("int"), ((F.size("raw") > 1) & (F.element_at("raw", -1) == "")).cast("int")
    names = [c for c in raw.columns if c != "raw"]
    return raw.select(*names, F.explode(F.array(F.slice("raw", first + 1, F.size("raw") - first - last))).alias("words"))


def shingle_array(width: int, words: str = "words") -> Column:
    """XXH64 of each run of `width` words; empty if there are fewer words."""
    n = F.size(words) - (width - 1)
    at = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(width)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column, most: int) -> Column:
    """64 bits, each 1 if over half of the hashes have it. Several bits are counted at a
    time, in lanes of a long that are wide enough for `most` hashes."""
    lane = 8 if most < 1 << 8 else 16 if most < 1 << 16 else 32
    n, out = F.size(hashes).cast("long"), F.lit(0).cast("long")
    ones = F.lit(sum(1 << i for i in range(0, BITS, lane))).cast("long")

    def sums(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(ones))

    for b in range(lane):
        many = sums(b)
        for at in range(0, BITS, lane):
            count = F.shiftrightunsigned(many, at).bitwiseAND(F.lit((1 << lane) - 1))
            out = out.bitwiseOR(F.when(2 * count > n, F.lit(signed(1 << (b + at)))).otherwise(F.lit(0).cast("long")))
    return out


def block_masks(radius: int) -> list[int]:
    """radius + 1 blocks of bits: fingerprints within the radius agree in one."""
    n = min(radius + 1, BITS)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:], strict=False)]


def _sized(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, radius: int = 23, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance, text_hash): for every
    document and item the window of n_words words from word `start` that is most
    similar, the first of equals that start at a shared shingle or end with the text, where
    the similarity is at least as asked for. The window has the item's length, or is the
    whole document if that is shorter.

    radius: of 64 bits, windows of a similarity of 0.8 differ in about 10 (deviation 3), so
    a window beyond 23 is one of about 100,000 at just that similarity, and rarer above.
    Such wide blocks rule few items out; what keeps the pairs few is that only windows with
    enough shingles of some item are fingerprinted. Null or empty texts have no words and match
    nothing. Items of under five words match as whole sequences. Rows that agree in
    doc_id and text give one result; text_hash tells rows of one doc_id apart. Null ids
    stay null. An empty table of either kind gives an empty result. Other columns are not
    read. A very long text's words are held in one row, its windows are rows of their own.
    The items' shingles and the windows' documents are broadcast up to
    most_broadcast rows, else joined by shuffles; documents without a shared shingle
    are never shuffled.
    """
    items = written(_words(benchmark, item_text_col, [F.col(item_col).cast("long").alias("item_id")]).where(F.size("words") > 0), "items")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WIDTH)).alias("w")).distinct().collect()]  # 1 to 5
    row = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash")]
    schema = "doc_id long, item_id long, start int, n_words int, similarity double, distance int, text_hash long"
    out = docs.sparkSession.createDataFrame([], schema)
    for width in sorted(lengths):
        own = items.where(F.least(F.size("words"), F.lit(WIDTH)) == width)
        found = _contaminated(docs, own, width, row, text_col, similarity, radius, most_broadcast)
        out = out.unionByName(found.select(*out.columns))
    return out


def _contaminated(docs: DataFrame, items: DataFrame, width: int, row: list[Column], text_col: str, similarity: float, radius: int, most: int) -> DataFrame:
    texts = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.array_join(F.slice("words", i + 1, width), " "))
    hashed = items.select("item_id", F.size("words").alias("w"), F.explode(F.array(shingle_array(width))).alias("h"), texts.alias("shingles"))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    items = written(hashed.select("*", F.explode(F.array(simhash(F.col("h"), longest))).alias("item_fp")), "item_prints")
    known = written(items.select("w", F.explode("h").alias("h")).distinct(), "item_shingles")

    # places of shingles that some item of a length has
    words = _words(docs, text_col, row)
    here = words.where(F.size("words") >= width).select("doc_id", "text_hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("pos"))
    at = here.select("doc_id", "text_hash", F.size("words").alias("n"), "pos", F.xxhash64(*(F.get("words", F.col("pos") + k) for k in range(width))).alias("h"))
    hits = at.join(_sized(known, most), "h")
    by_length = hits.groupBy("doc_id", "text_hash", "w").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("pos"))
    size = F.least("w", "n")
    sized = by_length.withColumn("size", size).withColumn("in_window", F.col("size") - (width - 1))
    sized = sized.withColumn("need", F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("in_window") + F.col("w") - (width - 1)) - 1e-9).cast("int"))
    rich = F.filter("pos", lambda p, j: F.coalesce(F.get(F.col("pos"), j + F.col("need") - 1) < p + F.col("in_window"), F.lit(False)))
    starts = F.array_distinct(F.transform(rich, lambda p: F.least(p, F.col("n") - F.col("size"))))
    windows = sized.select("doc_id", "text_hash", "w", "size", starts.alias("starts")).where(F.size("starts") > 0)

    # their words, from those documents alone
    per_doc = windows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("w", "size", "starts")).alias("windows"))
    per_doc = written(per_doc, "window_docs").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "windows")
    these = (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("text_hash") == F.col("t"))
    wanted = docs.select(*row, F.col(text_col).alias("text")).join(_sized(per_doc, most // 10), these).drop("d", "t")
    met = _words(wanted.dropDuplicates(["doc_id", "text_hash"]), "text", [F.col("doc_id"), F.col("text_hash"), F.col("windows")])
    lengths = met.select("doc_id", "text_hash", "words", F.explode("windows").alias("x")).select("doc_id", "text_hash", "words", "x.w", "x.size", F.explode("x.starts").alias("start"))
    one = lengths.select("doc_id", "text_hash", "w", "start", F.col("size").alias("n_words"), F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    one = one.repartition(partitions(docs.sparkSession), "doc_id", "text_hash", "start")  # a text's windows go to all tasks
    hashed = one.select("*", F.explode(F.array(shingle_array(width))).alias("h"))
    printed = hashed.select("doc_id", "text_hash", "w", "start", "n_words", "words", F.explode(F.array(simhash(F.col("h"), longest))).alias("fp"))

    # fingerprints find the items of their length in blocks
    masks = [signed(m) for m in block_masks(radius)]
    blocks = lambda fp: F.posexplode(F.array(*(F.col(fp).bitwiseAND(F.lit(m)) for m in masks))).alias("block", "value")
    item_blocks = items.select("item_id", "w", "item_fp", blocks("item_fp"))
    pairs = printed.select("*", blocks("fp")).join(_sized(written(item_blocks, "item_blocks"), most), ["w", "block", "value"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    near = pairs.where((F.bit_count(differ) <= radius) & (F.col("block") == first)).select("doc_id", "text_hash", "item_id", "start", "n_words", F.bit_count(differ).alias("distance"), "words")

    # and are verified on their shingles
    shingles = F.transform(F.sequence(F.lit(0), F.col("n_words") - width), lambda i: F.array_join(F.slice("words", i + 1, width), " "))
    key = ["doc_id", "text_hash", "item_id", "start", "n_words", "distance"]
    counts = near.select(*key, F.explode(shingles).alias("shingle")).groupBy(*key, "shingle").agg(F.count("*").alias("here"))
    item_counts = items.select("item_id", (F.col("w") - (width - 1)).alias("item_n"), F.explode("shingles").alias("shingle")).groupBy("item_id", "item_n", "shingle").agg(F.count("*").alias("there"))
    shared = counts.join(_sized(written(item_counts, "item_counts"), most), ["item_id", "shingle"]).groupBy(*key, "item_n").agg(F.sum(F.least("here", "there")).alias("both"))
    share = F.col("both") / (F.col("item_n") + F.col("n_words") - (width - 1) - F.col("both"))
    good = shared.select(*key, share.alias("similarity")).where(F.col("similarity") >= similarity)
    best = good.groupBy("doc_id", "text_hash", "item_id").agg(F.min_by(F.struct("start", "n_words", "similarity", "distance"), F.struct(-F.col("similarity"), F.col("start"))).alias("x"))
    return best.select("doc_id", "text_hash", "item_id", "x.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a match, all columns as they are; see contaminated. What
    matched is broadcast up to 50,000 rows, else joined by a shuffle."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("d_"), F.col("text_hash").alias("t_")).distinct()
    found = _sized(written(found, "contaminated"), 50_000)
    d, t = found.columns
    ids, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    return docs.join(found, F.col(ids).cast("long").eqNullSafe(found[d]) & (F.xxhash64(docs[text]) == found[t]), "left_anti")
