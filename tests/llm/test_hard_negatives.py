"""Hard negatives against sorting all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, ablock string"


def brute(rows, every=5, positives=5, negatives=3):
    known = [(i, [max(-H.MOST, min(H.MOST, int(np.floor(256 * float(np.float32(x)))))) for x in v], k) for i, v, k, *_ in rows if None not in (i, v, k) and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for a, (i, v, k) in enumerate(known):
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, n) for n, (j, w, _) in enumerate(known)]
        like = sorted(s for s in scores if s[2] != a and known[s[2]][2] == k)[:positives]
        for p, j, _ in like:
            fit = sorted((s, x) for s, x, n in scores if known[n][2] != k and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(i, j, r, x, -p, -s) for r, (s, x) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 5 == 0, **how).collect()))


def vectors(seed, many=220):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.5, 6)], int(rng.integers(0, 3)), 1, "x") for i in range(many)]
    rows += [(1000 + i, [0.5] * 6, i % 3, 1, "x") for i in range(150)]  # one vector, many times
    odd = [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")], 1), (2003, [float("inf")], 1), (2004, [1.0], None), (None, [1.0], 1), (2005, [], 0), (2010, [], 2), (2015, [1.0] * 9, 0), (2020, [1e30, -1e30], 1), (2025, [9.0] * 6, 1)]
    rows += [(*r, None, None) for r in odd]
    return [*rows, rows[0], rows[0], rows[5], rows[-3]]  # repeated rows, anchors among them


@pytest.mark.parametrize(("few", "blocks"), [(64, (4096, 16_384)), (0, (16, 7))])
def test_mined_is_brute_force(spark, monkeypatch, few, blocks):
    """In one step, and counting down to single scores and ids over many small blocks."""
    monkeypatch.setattr(H, "FEW_ROWS", few)
    rows = vectors(1)
    got = mined(spark, rows, rows_a_block=blocks[0], anchors_a_block=blocks[1])
    want = brute([r[:3] for r in rows])
    assert got == want and len(want) > 300


def test_none(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1, 0, "")]) == [] and mined(spark, [(5, [1.0], 1, 0, "")]) == []


def test_buckets_cover_extremes():
    """64-bit ids and scores: no bucket is out of range, and order is kept."""
    w = object.__new__(H._Windows)
    far = (1 << 62) - 1
    low, high = -(1 << 63), (1 << 63) - 1
    w.s_lo, w.s_hi, w.i_lo, w.i_hi = (np.array(v, "i8") for v in ([-far, 3], [far, 3], [low, low], [high, high]))
    scores = np.array([far, 0, -far])
    b = w.buckets(np.zeros(3, int), np.zeros(3, "i8"), scores)
    assert b[0] == 0 and list(b) == sorted(b) and b[2] <= 63
    ids = np.array([low, -1, 0, high])
    b = w.buckets(np.ones(4, int), ids, np.full(4, 3))
    assert b[0] == 0 and list(b) == sorted(b) and b[3] == 63
