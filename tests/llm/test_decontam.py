"""Recall of the fingerprints' blocks against brute force, long texts and many copies."""

from collections import Counter

import numpy as np

from emberline.llm import decontam


def best(own, item):
    """The greatest similarity of a window of the item's length."""
    shingles = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1))
    n, want, top = min(len(item), len(own)), shingles(item), 0.0
    for a in range(len(own) - n + 1):
        x = shingles(own[a : a + n])
        top = max(top, sum((x & want).values()) / sum((x | want).values()))
    return top


def test_recall_near_the_threshold(spark):
    """500 windows around 0.8, of items of few and of many words, some of equal length:
    all of 0.8 at least are found, with the brute-force similarity."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    items = {i: [word() for _ in range(n)] for i, n in enumerate((20, 20, 45, 45, 80, 80, 300, 12))}
    texts, want = {}, {}
    for d in range(500):
        i = d % len(items) if d < 300 else 6
        own = list(items[i])
        for _ in range(int(rng.integers(0, max(2, len(own) // 40 + 2)))):
            own[int(rng.integers(len(own)))] = word()
        texts[d] = [word() for _ in range(int(rng.integers(0, 60)))] + own + [word() for _ in range(int(rng.integers(0, 60)))]
        s = best(texts[d], items[i])
        if s >= 0.8 - 1e-12:
            want[d, i] = round(s, 9)
    docs = spark.createDataFrame([(d, " ".join(w), "x", 1) for d, w in texts.items()], "doc_id long, text string, words string, w int")
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()], "item_id long, text string, start int")
    rows = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want
    assert all(round(best(texts[r.doc_id][r.start : r.start + r.n_words], items[r.item_id]), 9) == want[r.doc_id, r.item_id] for r in rows)
    assert sum(s < 0.85 for s in want.values()) > 30 and len(want) < 490
    assert decontam.keep_clean(docs, bench).columns == docs.columns


def test_many_copies_and_a_long_text(spark):
    item = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(item * 100)), (2, "x " * 50_000 + " ".join(item)), (2, "x " * 50_000 + " ".join(item)), (None, " ".join(item[:55])), (4, " ".join(item[:40]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.start, r.similarity) for r in decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()), key=str)
    assert got == [(0, 0, 51 / 56), (1, 0, 1.0), (2, 50_000, 1.0)]
