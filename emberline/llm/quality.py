"""Quality rules: fixed base rules, then robust multivariate outliers.

The outlier rule describes a document by four transformed statistics, estimates their
location and scatter for each language and source by minimum covariance determinants,
and rejects documents at a large Mahalanobis distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.skew import lookup
from ..operators.storage import discard
from ..operators.tables import free_names
from .common import ASCII_SPACE, placed, release_memos, small_batches, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*BASE, "n_lines"]
FEATURES = ["x0", "x1", "x2", "x3"]
#: Least standard deviation of a feature between documents of a group: scatter below
#: it is never held against a document.
FLOOR = np.array([0.06, 0.05, 0.15, 0.15])


def repeat_words(own: list[str]) -> int:
    """Words that lie in windows of five words that the text has twice or more."""
    n = len(own) - WINDOW + 1
    if n < 2:
        return 0
    line = " ".join(own)
    starts = [0, *accumulate(len(w) + 1 for w in own)]
    windows = [line[a : b - 1] for a, b in zip(starts, starts[WINDOW:], strict=False)]
    if len(set(windows)) == n:
        return 0
    counts, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text; zeros for null."""
    if not text:
        return (0,) * len(STATS)
    own = words(text)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(own), sum(map(len, own)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(own), len(lines)


def _with_stats(docs: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """docs with STATS behind its own columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memos()
        for batch in batches:
            rows = np.array([text_stats(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in rows.T)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words"):
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def features(stat=lambda n: F.col(n)) -> list:
    """Mean word length (log), and the shares of symbols in the words' characters, of
    repeated lines and of repeated words (arcsine of the root)."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), stat(a) / F.greatest(stat(b), F.lit(1)))))
    return [F.log(F.greatest(stat("word_chars"), F.lit(1)) / F.greatest(stat("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def sampling(stat=lambda n: F.col(n)) -> list:
    """Variances of the features from a text's own length: short texts vary more."""
    one = lambda n: F.greatest(stat(n), F.lit(1))
    return [0.36 / one("n_words"), 0.25 / one("word_chars"), 0.25 / one("n_lines"), 0.25 * WINDOW / one("n_words")]


def _chi2_share(x: float, df: int) -> float:
    """Distribution function of chi-square for even degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - exp(-x / 2) * total


def consistency(share: float, dims: int = 4) -> float:
    """Factor that makes the scatter of the innermost share of normal data unbiased."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_share(mid, dims) < share else (low, mid)
    return share / _chi2_share(low, dims + 2)


#: Bins of the histograms: of a feature, and of the logarithm of a squared distance.
X_BIN, LOG_BINS = 0.001, 256
CELLS = [(i, j) for i in range(4) for j in range(i, 4)]
LOC, SCAT, INV = [f"m{i}" for i in range(4)], [f"s{i}{j}" for i, j in CELLS], [f"v{i}{j}" for i, j in CELLS]
_ESTIMATE = ", ".join(f"{c} double" for c in [*LOC, *SCAT, *INV, "logdet"])


def _square(cells: np.ndarray) -> np.ndarray:
    """(rows, 10) upper triangles as (rows, 4, 4)."""
    s = np.zeros((len(cells), 4, 4))
    i, j = np.triu_indices(4)
    s[:, i, j] = s[:, j, i] = cells
    return s


def _finished(df: DataFrame, keep: list[str], schema: str, scatter) -> DataFrame:
    """keep, LOC, SCAT, INV and logdet of a small table with LOC; scatter: from a batch as
    columns by name to (rows, 4, 4)."""
    names = [*keep, *LOC, *SCAT, *INV, "logdet"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(4)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            s = scatter(x)
            inv, logdet = np.linalg.inv(s), np.linalg.slogdet(s)[1]
            out = [*(batch.column(n) for n in keep), *(pa.array(x[c].astype(float)) for c in LOC), *(pa.array(s[:, a, b]) for a, b in CELLS), *(pa.array(inv[:, a, b]) for a, b in zip(i, j, strict=True)), pa.array(logdet)]
            yield pa.RecordBatch.from_arrays(out, names)

    return df.mapInArrow(run, f"{schema}, {_ESTIMATE}")


def _pools(rows: DataFrame, x: list[str] = FEATURES) -> DataFrame:
    """A row for each of a row's three pools: all rows, its language, its language and
    source. A pool's name is a hash of what it holds."""
    names = [F.xxhash64(F.lit("all")), F.xxhash64(F.lit("lang"), "lang"), F.xxhash64(F.lit("source"), "lang", "source")]
    return rows.select(F.explode(F.array(*names)).alias("pool"), *x)


def _cut(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """by, n and the value of the first bin up to which that share of n lies."""
    window = Window.partitionBy(*by)  # a row for each bin, whose number is bounded
    ranked = bins.withColumns({"upto": F.sum("n").over(window.orderBy("bin")), "all": F.sum("n").over(window)})
    return ranked.where(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias("bin"), F.first("all").alias("n"))


def _medians(pooled: DataFrame, value) -> DataFrame:
    """(pool, n, q0..q3): medians of value(feature number) to X_BIN."""
    bins = pooled.select("pool", F.posexplode(F.array(*(F.round(value(k) / X_BIN).cast("long") for k in range(4)))).alias("k", "bin")).groupBy("pool", "k", "bin").agg(F.count("*").alias("n"))
    cut = _cut(bins, ["pool", "k"], 0.5)
    return cut.groupBy("pool").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("k") == k, F.col("bin") * X_BIN)).alias(f"q{k}") for k in range(4)))


def _known(pooled: DataFrame, est: DataFrame, pools: int, total: int) -> DataFrame:
    """Rows of each pool with its estimates: broadcast up to 20,000 pools (250 bytes each),
    beyond that only the hot pools'."""
    if pools <= 20_000:
        return pooled.join(F.broadcast(est.drop("n")), "pool")
    return lookup(pooled, est, ["pool"], total=total, how="inner")


def determinants(rows: DataFrame, *, share: float = 0.75, max_steps: int = 15) -> DataFrame:
    """rows (lang, source, x0..x3) -> (pool, n, LOC, SCAT): for every pool the location and
    scatter of the `share` of its rows whose covariance has the least determinant that
    concentration steps come to from two starts: distances from the medians in units of the
    median deviations, and such distances by the covariance of their directions.

    A step is one pass over all rows: their distances in bins of 0.4 per cent with partial
    sums of what a covariance needs; so no task holds a pool, however large it is. The
    innermost bins that hold the share are taken whole, so ties stay together and the
    order of rows doesn't matter. Scatter has FLOOR added, so it is never singular.
    """
    pooled = _pools(rows)
    sized = written(_medians(pooled, lambda k: F.col(f"x{k}")), "medians")
    pools, total = sized.count(), 3 * rows.count()
    mads = _medians(_known(pooled, sized, pools, total), lambda k: F.abs(F.col(f"x{k}") - F.col(f"q{k}")))
    scale = [F.greatest(1.4826 * F.col(f"d{k}"), F.lit(float(FLOOR[k]))).alias(f"d{k}") for k in range(4)]
    spread = written(sized.join(mads.drop("n").withColumnsRenamed({f"q{k}": f"d{k}" for k in range(4)}), "pool").select("pool", "n", *(f"q{k}" for k in range(4)), *scale), "spread")

    # directions: the covariance of unit vectors, in units of the deviations
    z = [(F.col(f"x{k}") - F.col(f"q{k}")) / F.col(f"d{k}") for k in range(4)]
    unit = _known(pooled, spread, pools, total).select("pool", *(v.alias(f"z{k}") for k, v in enumerate(z))).withColumn("r2", sum(F.col(f"z{k}") ** 2 for k in range(4)))
    signs = unit.where("r2 > 0").groupBy("pool").agg(*(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("r2")).alias(f"u{i}{j}") for i, j in CELLS))
    known = spread.join(signs, "pool", "left").withColumnsRenamed({f"q{k}": LOC[k] for k in range(4)})
    starts = known.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))

    def first(x: dict) -> np.ndarray:
        d = np.stack([x[f"d{k}"] for k in range(4)], axis=1)
        signs = np.nan_to_num(np.stack([x[f"u{i}{j}"].astype(float) for i, j in CELLS], axis=1))
        turned = _square(signs) * 4 + 0.05 * np.eye(4)
        s = np.where((x["start"] == 1)[:, None, None], turned, np.eye(4))
        return s * d[:, :, None] * d[:, None, :]

    keep, schema = ["pool", "n", "start"], "pool long, n long, start int"
    est = written(_finished(starts, keep, schema, first), "start").withColumn("low", F.lit(float("inf")))
    discard(sized)

    def concentrated(x: dict) -> np.ndarray:
        s = np.stack([x[c].astype(float) for c in SCAT], axis=1)
        return _square(s) + np.diag(FLOOR**2)

    h = F.least(F.col("n"), F.greatest(F.lit(5), F.ceil(F.lit(share) * F.col("n"))))
    for step in range(max_steps):
        at = _known(pooled, est, pools, total) if pools <= 20_000 else lookup(pooled.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), est, ["pool", "start"], total=2 * total, how="inner")
        off = at.select("pool", "start", *(F.col(f"m{k}").alias(f"m{k}") for k in range(4)), *INV, *((F.col(f"x{k}") - F.col(f"m{k}")).alias(f"y{k}") for k in range(4)))
        d2 = sum((1 if i == j else 2) * F.col(f"v{i}{j}") * F.col(f"y{i}") * F.col(f"y{j}") for i, j in CELLS)
        binned = off.withColumn("bin", F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * LOG_BINS).cast("int"))
        sums = [F.sum(f"y{k}").alias(f"y{k}") for k in range(4)] + [F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"y{i}{j}") for i, j in CELLS]
        bins = binned.groupBy("pool", "start", "bin").agg(F.count("*").alias("here"), *sums)
        window = Window.partitionBy("pool", "start").orderBy("bin")  # a row for each bin
        ranked = bins.join(est.select("pool", "start", "n", *(F.col(c).alias(f"old_{c}") for c in LOC), F.least("low", F.when(F.lit(step > 0), F.col("logdet")).otherwise(F.lit(float("inf")))).alias("low")), ["pool", "start"]).withColumn("upto", F.sum("here").over(window))
        inner = ranked.where(F.col("upto") - F.col("here") < h).groupBy("pool", "start").agg(F.first("n").alias("n"), F.sum("here").alias("taken"), F.first("low").alias("low"), *(F.first(f"old_{c}").alias(f"old_{c}") for c in LOC), *(F.sum(c).alias(c) for c in [f"y{k}" for k in range(4)] + [f"y{i}{j}" for i, j in CELLS]))
        mean = {f"y{k}": F.col(f"y{k}") / F.col("taken") for k in range(4)}
        moved = inner.select("pool", "n", "start", "taken", "low", *((F.col(f"old_m{k}") + mean[f"y{k}"]).alias(f"m{k}") for k in range(4)), *((F.col(f"y{i}{j}") / F.col("taken") - mean[f"y{i}"] * mean[f"y{j}"]).alias(f"s{i}{j}") for i, j in CELLS))
        est = written(_finished(moved, [*keep, "taken", "low"], f"{schema}, taken long, low double", concentrated), "step")
        steps = est if step == 0 else steps.union(est)
        fell = est.agg(F.max(F.col("low") - F.col("logdet"))).first()[0]  # below the least determinant so far
        if fell is None or fell < 1e-6:
            break
    best = steps.groupBy("pool").agg(F.min_by(F.struct("n", "taken", *LOC, *SCAT), F.struct("logdet", "start")).alias("x")).select("pool", "x.*")
    return best


def estimates(rows: DataFrame, weight: float = 100.0) -> DataFrame:
    """(lang, source, n, LOC, SCAT) from rows (lang, source, x0..x3): the determinants'
    estimate of each language and source, the scatter made consistent for normal data.
    A group's estimate is drawn to its language's, and that to the one of all rows, as
    if `weight` rows of the larger pool belonged to it; so a small group is judged mostly
    by its language, and no size decides."""
    found = written(determinants(rows), "determinants")
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    names = {"a": F.xxhash64(F.lit("all")), "l": F.xxhash64(F.lit("lang"), "lang"), "g": F.xxhash64(F.lit("source"), "lang", "source")}
    met = groups.withColumns({f"{k}_pool": v for k, v in names.items()})
    levels = list(names)  # from all rows to the group
    for k in levels:
        own = found.select(*(F.col(c).alias(f"{k}_{c}") for c in found.columns))
        met = met.join(own, f"{k}_pool")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in ("lang", "source")}
            loc = scat = None
            for k in levels:
                n, taken = x[f"{k}_n"].astype(float), x[f"{k}_taken"].astype(float)
                m = np.stack([x[f"{k}_{c}"] for c in LOC], axis=1)
                share, at = np.unique(np.where(taken < n, taken / n, 0.9999999), return_inverse=True)
                grow = np.array([consistency(s) for s in share])[at]
                s = (_square(np.stack([x[f"{k}_{c}"] for c in SCAT], axis=1)) - np.diag(FLOOR**2)) * grow[:, None, None] + np.diag(FLOOR**2)
                if loc is not None:
                    own = (n / (n + weight))[:, None]
                    apart = m - loc
                    between = (own * (1 - own) * apart)[:, :, None] * apart[:, None, :]
                    s = own[:, :, None] * s + (1 - own)[:, :, None] * scat + between
                    m = own * m + (1 - own) * loc
                loc, scat = m, s
            out = [batch.column("lang"), batch.column("source"), batch.column("rows"), *(pa.array(loc[:, k]) for k in range(4)), *(pa.array(scat[:, i, j]) for i, j in CELLS)]
            yield pa.RecordBatch.from_arrays(out, ["lang", "source", "n", *LOC, *SCAT])

    return met.mapInArrow(run, "lang string, source string, n long, " + ", ".join(f"{c} double" for c in [*LOC, *SCAT]))


def mahalanobis2(location: np.ndarray, scatter: np.ndarray, own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of rows x, each from its group's location in its scatter (the
    upper triangle by rows) plus the document's own variances."""
    s = _square(scatter)
    s[:, range(4), range(4)] += own
    d = x - location
    return (np.linalg.solve(s, d[:, :, None])[:, :, 0] * d).sum(axis=1)


@F.pandas_udf(DoubleType())
def _distance(est: pd.Series, x: pd.DataFrame, own: pd.DataFrame) -> pd.Series:
    out = np.full(len(est), np.nan)
    known = est.notna().to_numpy()
    if known.any():
        e = np.stack(est[known].to_list())
        out[known] = mahalanobis2(e[:, :4], e[:, 4:], own.to_numpy(float)[known], x.to_numpy(float)[known])
    return pd.Series(out).astype(object).where(known, None)


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = 23.5, weight: float = 100.0, stats_only: bool = False) -> tuple[DataFrame, list[str]]:
    """docs with columns behind its own: STATS, base_failed, distance2, kept. Returns the
    table and those columns' names, which differ from docs' own.

    kept is false where a base rule fails, else whether the squared Mahalanobis distance
    from the row's language and source is at most cutoff (normal data of four dimensions
    exceed 23.5 in one of 10,000 rows). weight: see estimates. Null languages and sources are groups of their own. A null text has
    no words and fails a base rule; a very long one is read whole. Repeated doc_ids and
    equal rows stay, each with the same verdict; an empty table gives an empty result. With
    stats_only the text is left out, so that it isn't written.
    """
    names = free_names(docs, *STATS, "base_failed", "distance2", "kept", "emb_lang", "emb_source", *FEATURES)
    stat = dict(zip(STATS, names, strict=False))
    failed, distance2, kept, lang, source = names[len(STATS) : len(STATS) + 5]
    xs = names[len(STATS) + 5 :]
    col = lambda n: F.col(f"`{stat[n]}`")
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    counted = _with_stats(docs, text_col, names[: len(STATS)]).drop(*([text_col] if stats_only else []))
    full = counted.select("*", base_failed(f"`{stat['n_words']}`", f"`{stat['n_repeat_words']}`").alias(failed), value(lang_col).alias(lang), value(source_col).alias(source), *(f.alias(n) for f, n in zip(features(col), xs, strict=True)))
    table = written(full, "quality")
    used = table.where(~F.col(failed)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *(F.col(a).alias(b) for a, b in zip(xs, FEATURES, strict=True)))
    known = estimates(used, weight).select(F.col("lang").alias(lang), F.col("source").alias(source), F.array(*LOC, *SCAT).alias("emb_est"))
    sizes = table.groupBy(lang, source).agg(F.count("*").alias("n"))  # a group that fails whole has no estimate, and needs none
    met = lookup(table, written(sizes.join(known, [lang, source], "left"), "groups"), [lang, source], total=table.count())
    d2 = _distance(F.col("emb_est"), F.struct(*(F.col(c).alias(n) for c, n in zip(xs, FEATURES, strict=True))), F.struct(*(v.alias(n) for v, n in zip(sampling(col), FEATURES, strict=True))))
    out = met.withColumn(distance2, d2).withColumn(kept, ~F.col(failed) & (F.coalesce(F.col(distance2), F.lit(0.0)) <= cutoff))
    shown = [*counted.columns, failed, distance2, kept]
    return out.select(*(F.col(f"`{c}`") for c in shown)), [*names[: len(STATS)], failed, distance2, kept]


def quality_verdicts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, BASE, base_failed, kept, distance2) for each row; see judge."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    table, _ = judge(rows, stats_only=True, **options)
    return table.select("doc_id", *BASE, "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that are kept, all columns as they are; see judge. docs is read
    twice; the verdicts are joined by the rows' places in the stored files (see placed), so
    texts of a stored table aren't copied. The rejected rows' places are broadcast up to a
    million, of 16 bytes."""
    file, row = free_names(docs, "file", "row")
    stored = placed(docs, file, row)
    rows = stored.select(F.col(file).alias("file"), F.col(row).alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    table, names = judge(rows, stats_only=True, **options)
    goes = written(table.where(~F.col(names[-1])).select(F.col("file").alias(file), F.col("id").alias(row)), "rejected")
    gone = F.broadcast(goes) if goes.count() <= 1_000_000 else goes
    return stored.join(gone, [file, row], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
