"""Robust estimates and verdicts against a version that sorts each pool's rows."""

import math

import numpy as np
import pytest

from emberline.llm import quality


def brute_mcd(x, share=0.75):
    """The least determinant over many starts, by exact sorts."""
    n, d = x.shape
    h = min(n, max(d + 1, math.ceil(share * n)))
    rng, best = np.random.default_rng(0), (np.inf, None, None, 0)
    for start in range(60):
        own = rng.choice(n, min(n, d + 2), replace=False) if start else np.arange(n)
        for _ in range(60):
            s = np.cov(x[own].T, bias=True) + np.diag(quality.FLOOR**2)
            far = ((x - x[own].mean(axis=0)) @ np.linalg.inv(s) * (x - x[own].mean(axis=0))).sum(axis=1)
            own = np.argsort(far, kind="stable")[:h]
        s = np.cov(x[own].T, bias=True) + np.diag(quality.FLOOR**2)
        if np.linalg.slogdet(s)[1] < best[0]:
            best = (np.linalg.slogdet(s)[1], x[own].mean(axis=0), s, h / n)
    return best


def pools():
    """A hot source with half of all rows, others, one tiny; a tenth of the rows far off."""
    rng = np.random.default_rng(1)
    rows = []
    for lang, source, n, at in (("a", "hot", 2000, 0.0), ("a", "x", 900, 0.5), ("b", "x", 900, -1.0), ("b", "y", 3, -1.0)):
        mix = rng.normal(size=(4, 4)) * 0.1 + np.diag([0.3, 0.3, 0.4, 0.5])
        x = rng.normal(size=(n, 4)) @ mix + at
        x[: n // 10] += [4, 4, 0, 0]
        rows += [(lang, source, *map(float, v)) for v in x]
    return rows


def test_determinants_are_brute_force(spark):
    rows = pools()
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in quality.FEATURES)).repartition(7)
    got = {r.n: r for r in quality.determinants(df).collect()}
    all_x = np.array([r[2:] for r in rows])
    own = {("a", "hot"): 2000, ("b", "x"): 900}
    for (lang, source), n in own.items():
        x = np.array([r[2:] for r in rows if r[:2] == (lang, source)])
        logdet, location, scatter, _ = brute_mcd(x)
        found = [r for r in quality.determinants(df.where(f"lang = '{lang}' and source = '{source}'")).collect() if r.n == n][0]
        s = np.zeros((4, 4))
        for i, j in quality.CELLS:
            s[i, j] = s[j, i] = found[f"s{i}{j}"]
        assert abs(np.linalg.slogdet(s)[1] - logdet) < 0.02 and abs(found.taken - math.ceil(0.75 * n)) <= 0.01 * n
        assert np.abs(np.array([found[c] for c in quality.LOC]) - location).max() < 0.03
        assert np.abs(s - scatter).max() < 0.05 * np.abs(scatter).max()
    assert got[len(all_x)].taken >= math.ceil(0.75 * len(all_x))


def test_verdict_distances(spark):
    """Planted rows are far, others aren't, and neither splits of the table nor repeats of
    a row change what another row gets."""
    rows = pools()
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in quality.FEATURES))
    est = {(r.lang, r.source): r for r in quality.estimates(df.repartition(5)).collect()}
    again = {(r.lang, r.source): r for r in quality.estimates(df.coalesce(1)).collect()}
    assert set(est) == {r[:2] for r in rows}
    for k, r in est.items():
        assert np.allclose(list(r)[2:], list(again[k])[2:], rtol=1e-9)
        x = np.array([v[2:] for v in rows if v[:2] == k])
        far = quality.mahalanobis2(np.array([r[c] for c in quality.LOC]), np.array([[r[f"s{i}{j}"] for i, j in quality.CELLS]] * len(x)), np.zeros((len(x), 4)), x)
        off = len(x) // 10
        assert (far[:off] > 23.5).all() and (far[off:] > 23.5).mean() < 0.005


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_tiny_tables(spark, n):
    text = "these are plain words of a plain text that nobody would ever reject at all"
    docs = spark.createDataFrame([(i, text, "en", None) for i in range(n)], "doc_id long, text string, lang string, source string")
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == n and all(r.kept for r in got)


def test_base_counts_of_long_and_odd_texts(spark):
    """Base columns by plain loops, one text of 200,000 words among them."""
    import re

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 300)), "a b c d e\n" * 40, "a\x0bb\x0c c\x85d\u2028e # $ é", " ".join(["long"] * 5 + [f"v{i}" for i in range(200_000)] + ["long"] * 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1 as n_words")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    for i, t in enumerate(texts):
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        windows = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {p for k, w in enumerate(windows) if seen[w] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(own) < 10 or 100 * len(covered) > 20 * len(own))
