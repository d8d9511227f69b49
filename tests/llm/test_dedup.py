"""Near copies against brute force, with groups too large for one task."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from near_copies import brute_near_groups
from pyspark.sql import functions as F

from emberline.llm import simhash
from emberline.operators.tables import at_places


def changed(rng, words, n):
    out = list(words)
    for at in rng.choice(len(words), n, replace=False):
        out[at] = f"x{rng.integers(0, 10**7)}"
    return out


def hot_texts():
    """Half of all texts are near copies of one text, in classes and chains at its edge."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10**7, 120)]
    texts = [" ".join(changed(rng, base, int(n))) for n in rng.integers(0, 4, 60)]
    for _ in range(6):  # chains that leave the group
        own = base
        for _ in range(6):
            own = changed(rng, own, 2)
            texts.append(" ".join(own))
    texts += [" ".join(changed(rng, base, 12)) for _ in range(20)]  # below 0.8 mostly
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 10**7, 40)) for _ in range(60)] + [None, "", "a"]
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize(("group_size", "hot_key"), [(4_000_000, 20_000), (1500, 20_000), (600, 30), (4_000_000, 30)])
def test_hot_groups_by_brute_force(spark, group_size, hot_key):
    texts = hot_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    root = brute_near_groups(texts)
    sizes = np.unique(root, return_counts=True)[1]
    assert sizes.max() > 60 and len(sizes) > 70
    got = sorted(r.doc_id for r in simhash.one_of_each(docs, group_size=group_size, hot_key=hot_key).collect())
    assert got == sorted(set(root))


def test_small_sets_are_not_filtered_by_bits(spark):
    """Texts of 4 to 29 shingles, many with one rare shingle, and no bit that may differ: all
    links of 0.8 are found all the same."""
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    texts = []
    for g in range(60):
        base = [word() for _ in range(int(rng.integers(8, 30)))]
        for _ in range(4):
            own = list(base)
            if rng.random() < 0.7:
                own[-1 if rng.random() < 0.5 else 0] = word()
            texts.append(own + ([word()] if rng.random() < 0.5 else []))
        texts.append(base)
    shared = [word() for _ in range(5)]
    texts += [shared + [word() for _ in range(int(rng.integers(0, 4)))] for _ in range(40)]  # one shingle in 40 texts
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = brute_near_groups([" ".join(t) for t in texts])
    kept = {r.doc_id for r in simhash.one_of_each(docs, radius=0).collect()}
    assert len(kept) == len(set(want)) < len(texts) - 60 and len({want[i] for i in kept}) == len(kept)


def test_fingerprints_meet_by_pigeonholes(spark, monkeypatch):
    """Copies with one word of 400 changed are found by their fingerprints alone."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 10**7, 400)]
        texts += [" ".join(base), " ".join(changed(rng, base, 1)[:400])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    near = {i for i in range(40) if sum(bin(int(a) ^ int(b)).count("1") for a, b in [simhash.fingerprints([simhash.shingle_set(t, 5) for t in texts[2 * i : 2 * i + 2]])]) <= 4}
    assert len(near) > 30
    asked = []
    search = simhash.near_edges
    monkeypatch.setattr(simhash, "rare_shingles", lambda hashes, *_: hashes[:0])
    monkeypatch.setattr(simhash, "near_edges", lambda *a, **k: asked.append(a) or search(*a, **k))
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert asked and kept == {2 * i for i in range(40)} | {2 * i + 1 for i in range(40) if i not in near}


def test_many_copies_leave_texts_unshuffled(spark, tmp_path):
    """Over a million places: the rows at them are found without a shuffle of the rows."""
    spark.range(1_400_000).select(F.col("id").alias("row"), (F.col("id") % 2).alias("file"), F.lit("text").alias("text")).write.parquet(f"file://{tmp_path}/rows")
    rows = spark.read.parquet(f"file://{tmp_path}/rows")
    places = rows.where("row % 7 > 0").select("file", "row")
    without = at_places(rows, places, "file", "row", keep=False)
    assert without.select("row").collect() == rows.where("row % 7 = 0").select("row").collect() and without.columns == rows.columns
    assert at_places(rows, places, "file", "row", keep=True).count() == places.count() > 1_000_000
    plan = without._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_only_shared_keys_are_dealt(spark, monkeypatch):
    """Keys of two rows and more, by brute force, from nodes of far numbers; texts without
    a shingle in common deal nothing but those packs."""
    monkeypatch.setattr(simhash, "KEYS_AT_ONCE", 100)
    rng = np.random.default_rng(5)
    rows = [(int(i % 3 << 33) + i, [int(x) for x in np.unique(rng.integers(-800, 800, int(rng.integers(0, 9))))] + [2**62] * (i % 2)) for i in range(400)]
    rows += [(7 << 40, [-(2**63), 5000]), ((7 << 40) + 1, [-(2**63)])]
    got = simhash.shared_keys(spark.createDataFrame(rows, "node long, keys array<long>").repartition(3), sum(len(k) for _, k in rows))
    of = {}
    for node, keys in rows:
        for k in keys:
            of.setdefault(k, []).append(node)
    want = sorted((k, n) for k, nodes in of.items() if len(nodes) > 1 for n in nodes)
    assert sorted(map(tuple, got.collect())) == want and len(of) > len({k for k, _ in want}) > 100
    made, real = {}, simhash.written

    def kept(df, name, *more):
        out = real(df, name, *more)
        return out if name in made else made.setdefault(name, out)

    monkeypatch.setattr(simhash, "written", kept)
    monkeypatch.setattr(simhash, "discard", lambda *a: None)
    words = rng.permutation(10**5)
    texts = [" ".join(f"w{x}" for x in words[40 * i : 40 * i + 40]) for i in range(50)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert simhash.one_of_each(docs).count() == 50
    assert made["shared_keys"].isEmpty() and made["distinct"].count() == 50 and made["prints"].selectExpr("sum(size(rare))").first()[0] == 800
