"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, file string, depth int"


def brute(rows, fork=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs, key=lambda v: v[:3])] for c, vs in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if fork else 0
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[d, tuple(turns[:d])].append(c)
    for d, t in members:
        if d:
            children[d - 1, t[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for (d, t), m in members.items():
        for e in range(d + 1):
            leaves[e, t[:e]] += not children[d, t]
            saved[e, t[:e]] += (len(m) - 1) * len(t[-1][1].encode()) if d else 0
    digest = lambda m, d: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == d).encode()).hexdigest()
    return sorted((min(m), d, min(members[d - 1, t[:-1]]) if d else None, len(m), children[d, t], leaves[d, t], saved[d, t], digest(m, d)) for (d, t), m in members.items())


def nodes(df, fork=True, **how):
    conv = F.col("conv_id")
    how |= {"fork_from": conv - conv % 5, "fork_at": F.crc32(conv.cast("string").cast("binary")) % 9} if fork else {}
    found = T.prefix_trie(df, **how)
    return sorted((tuple(r) for r in found.drop("text_file", "text_row").collect()), key=lambda r: r[:2])


def conversations(seed, many=60):
    """Conversations over few turns, so that they share prefixes; odd roles, texts and turns."""
    rng = random.Random(seed)
    out = []
    for c in range(many):
        for t in range(rng.choice([0, 1, 2, 3, 7, 12])):
            out.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "é", "b" * 50, "x" * 20_000]), "clash", 9))
    out += [(1000 + i, t, "user", f"same {t}", "clash", 9) for i in range(20) for t in range(40)]  # copies of a long one
    return [*out, (None, 1, "user", "no id", None, None), (3, 5, "user", "again", None, 1), (3, 5, "user", "again", None, 1)]


@pytest.mark.parametrize(("seed", "fork", "bits", "few"), [(1, True, 61, 250_000), (2, False, 61, 0), (3, True, 2, 250_000)])
def test_trie_is_brute_force(spark, monkeypatch, seed, fork, bits, few):
    """Also with rows that many share split, and with hashes of two bits, whose fingerprints
    collide, so that nodes have to be split."""
    monkeypatch.setattr(T, "FEW_ROWS", few)
    rows = conversations(seed, 25 if bits < 61 else 60)
    rows = [r for r in rows if bits == 61 or r[0] is None or r[0] < 1003]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = nodes(df, fork, hash_bits=bits), brute([r[:4] for r in rows], fork)
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want


def test_no_conversations_and_long_forks(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nodes(none) == [] and nodes(spark.createDataFrame([(None, 1, "u", "x", None, None)], SCHEMA), False) == []
    one = spark.createDataFrame([(1, 1, "u", "x", None, None)], SCHEMA)
    with pytest.raises(ValueError, match="most"):
        nodes(one, False, fork_from=F.lit(1), fork_at=F.lit(65))


def test_fingerprints_are_polynomials():
    """Scans, products and pieces against Python's integers; a conversation in three ranges."""
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, T.P, 500).astype("u8") for _ in range(2))
    a[:2], b[:2] = T.P - 1, T.P - 1
    assert [int(v) for v in T.mulmod(a, b)] == [int(x) * int(y) % T.P for x, y in zip(a, b, strict=True)]
    exponents = np.array([0, 1, 2, 61, 10**12])
    assert [int(v) for v in T.power(exponents)] == [pow(T.BASE, int(n), T.P) for n in exponents]
    at = np.r_[np.arange(300), np.arange(1), np.arange(199)]
    want, value = [], 0
    for x, k in zip(a, at, strict=True):
        value = ((value if k else 0) * T.BASE + int(x)) % T.P
        want.append(value)
    assert [int(v) for v in T.scan(a, at)] == want

    class End:
        def __init__(self, *v):
            self.range, self.conv_id, self.pos, self.fp = v

    ends = [End(0, 7, 2, 5), End(1, 7, 3, 6), End(3, 8, 1, 4)]
    assert T._carried(ends) == [(1, 7, 2, 5), (3, 7, 5, (5 * pow(T.BASE, 3, T.P) + 6) % T.P)]


def test_a_conversation_in_many_ranges(spark):
    rows = [(5, t, "user", f"t{t % 3}", None, None) for t in range(3000)] + [(6, t, "user", f"t{t % 3}", None, None) for t in range(2990)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nodes(df, False, chunk=1)
    assert len(got) == 3001 and {g[3] for g in got} == {1, 2} and [g[:2] for g in got] == [(5, d) for d in range(3001)]
    assert got[0][5:7] == (1, 2 * 2990) and got[2990][7] == hashlib.sha256(b"6").hexdigest() and got[3000][7] == hashlib.sha256(b"5").hexdigest()
