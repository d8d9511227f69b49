"""Secrets: patterns against plain ones, costs against all segmentations."""

import hashlib
import math
import random
import time

import pytest

from emberline.llm import queries, secrets as S

SCHEMA = "doc_id long, text string, spans string, value string, kind int"
WORDS = {"correct": 3.5, "horse": 3.0, "dragon": 2.5, "sun": 2.0, "sunny": 3.0}


def cheapest(value, words):
    """The least cost over all segmentations, of the segments that the scanner names."""
    n, single, more = len(value), S._alphabet(value), math.log10(2)
    costs = {(i, j): (j - i) * single for i in range(n) for j in range(i + 1, n + 1)}
    for i in range(n):
        for j in range(i + 3, n + 1):
            part = value[i:j]
            if part in words:
                costs[i, j] = min(costs[i, j], words[part])
    for i, j, c in S._dates(value):
        costs[i, j] = min(costs[i, j], c)
    best = {}

    def rest(i):
        if i == n:
            return 0.0
        if i not in best:
            best[i] = min(costs[i, j] + (more + rest(j) if j < n else 0.0) for j in range(i + 1, n + 1))
        return best[i]

    return rest(0)


def test_costs_are_the_cheapest_segmentation():
    rng = random.Random(2)
    for _ in range(300):
        value = "".join(rng.choice([*WORDS, "2019", "1987-06-05", "#", "kq", "7", "zp"]) for _ in range(rng.randint(1, 5)))
        if S._REPEAT.search(value):
            continue
        assert S.guess_cost(value, WORDS) == pytest.approx(cheapest(value, WORDS)), value


def test_kinds_of_segments():
    cost = lambda v: S.guess_cost(v, WORDS)
    assert cost("dragon") < cost("Dragon") < cost("dRaGon") and cost("Dragon") == pytest.approx(2.5 + math.log10(2))
    assert cost("dr4gon") == pytest.approx(2.5 + math.log10(2))
    assert cost("qwertyuiop") < 4 < cost("qpwoeiruty") and cost("1QAZ2wsx"[:4]) < 5
    assert cost("abcabcabcabc") < cost("abcabdabeabf") and cost("aaaaaaaaaaaaaaaa") < 4
    assert cost("19870605") < 5 and cost("xK9$mQ2!vL") > 15
    assert cost("") == 0 and cost("ẞİx9") > 0


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: r for r in S.find_secrets(df, **how).collect()}


def test_spans(spark):
    texts = [
        "password: hunter2 and PASSWD = 'Xk29dlq0Zz' then token:short",
        "AKIA" + "Q" * 16 + " AKIA123 " + "0123456789abcdef" * 2 + " " + "a" * 31,
        None,
        "",
        'ünï db_pwd = "xK9$mQ2!vL", Auth: dragonsun spin: abcdef',
        "the paſſword: longenough1 apiKey=abc_def/123=",  # long s isn't a letter of the name
        "secret=" + "dragon" * 2,
    ]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(9, texts[4], None, None, None), (9, texts[4], None, None, None), (None, texts[0], None, None, None)]
    rows += [(100 + i, "dragon sun horse hunter " * 30, None, None, None) for i in range(3)]
    got = found(spark, rows)
    spans = {i: [tuple(s) for s in r.spans] for i, r in got.items()}
    at = texts[0].index("PASSWD")
    assert spans[0] == [(at, 0, at + 20), (at + 10, 3, at + 20)] and (got[0].n_assign, got[0].n_guess) == (1, 1)
    assert [s[1:] for s in spans[1]] == [(1, 20), (2, 61)] and spans[2] == spans[3] == []
    at = texts[4].index("xK9")
    assert spans[4] == [(at, 3, at + 10)] == spans[9]
    assert [s[1] for s in spans[5]] == [0] or [s[1] for s in spans[5]] == [0, 3]
    assert [s[1] for s in spans[6]] == [0]  # words of other texts, twice: no guess
    assert None in got and found(spark, []) == {} and found(spark, [(1, "nothing", None, None, None)])[1].n_guess == 0


def test_a_secret_does_not_vouch_for_itself(spark):
    rows = [(i, "login pwd: wqxzkvjpq end", None, None, None) for i in range(200)]
    assert all(r.n_guess == 1 for r in found(spark, rows).values())
    rows += [(1000 + i, "a wqxzkvjpq here", None, None, None) for i in range(200)]
    assert all(r.n_guess == 0 for r in found(spark, rows).values())


def test_query_and_long_texts(spark, tmp_path):
    long = "x " * 400_000 + "token = " + "0f" * 20 + " pwd: " + "".join(random.Random(1).choices("abcXYZ019", k=30_000))
    spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r.doc_id: r for r in queries.op13_secrets(spark, str(tmp_path)).collect()}
    a = 800_000
    base = f"assign:{a}:{a + 48},hex:{a + 8}:{a + 48}"
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[1].spans == f"{base},guess:{a + 54}:{a + 30_054}"  # the first value repeats two characters
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == "" and time.time() - began < 120
