"""URL verdicts, shards, archives and token files: brute force, hot keys, odd tables."""

import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import public_tokenizers as P
import pytest

from emberline.llm import sharding, token_output, url_lm, warc


def brute_models(labelled, order):
    """Chance of a character after a context, by verdict: Witten and Bell's estimate."""
    seen = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for (host, path), verdict, n in labelled:
        text = "\x02" + host + path + "\x03"
        for i in range(1, len(text)):
            for k in range(min(order, i) + 1):
                seen[verdict][text[i - k : i]][text[i]] += n

    def chance(verdict, context, c):
        low = 1 / 256 if not context else chance(verdict, context[1:], c)
        own = seen[verdict].get(context)
        return (own[c] + len(own) * low) / (sum(own.values()) + len(own)) if own else low

    def score(host, path):
        text, total = "\x02" + host + path + "\x03", 0.0
        for i in range(1, len(text)):
            for k in range(min(order, i), -1, -1):
                context = text[i - k : i]
                if any(text[i] in seen[v].get(context, ()) for v in seen):
                    total += log(chance("block", context, text[i]) / chance("allow", context, text[i]))
                    break
        return round(total / (len(text) - 1), 9)

    return score


def urls():
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(3, 8))))
    out = [f"https://{word('abcde')}.com/en/{word('xyz')}{i % 40}" for i in range(60)]
    out += [f"http://www.example.com/en/7{word('mnop')}" for _ in range(60)]
    out += [f"http://{word('abcde')}.info/{word('xyz')}" for _ in range(30)] + [f"http://{word('mnop')}.info/{word('mnop')}" for _ in range(30)]
    return out + ["https://hot.info/xyzzy"] * 250 + [None] * 40 + ["no scheme"] * 10 + ["http://h" + "x" * 3000 + ".info/"]


def test_url_verdicts_by_brute_force(spark):
    texts = urls()
    rows = [(i if i != 3 else None, u, i, "c") for i, u in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n int, verdict string")
    got = url_lm.judge_urls(pages, order=3).collect()
    assert len(got) == len(rows) and Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by_url = {(r.host, r.path): r for r in got}
    counts = Counter((r.host, r.path) for r in got)
    ruled = {k: r.verdict for k, r in by_url.items() if r.rule}
    held = {(r.host, r.path) for r in spark.createDataFrame(list(counts), "host string, path string").where("pmod(xxhash64(host, path), 5) = 0").collect()}
    score = brute_models([(k, v, counts[k]) for k, v in ruled.items() if k not in held], 3)
    calm = sorted(score(*k) for k, v in ruled.items() if v == "allow" and k in held)
    limit = calm[-(-99 * len(calm) // 100) - 1] if calm else 0.0
    assert len(calm) > 3 and len(ruled) > 80
    for k, r in by_url.items():
        if k in ruled:
            assert r.score is None
        elif k == ("", ""):
            assert (r.verdict, r.rule, r.score) == ("allow", None, None)
        else:
            assert r.score == pytest.approx(score(*k), abs=1e-8) and r.verdict == ("block" if r.score > limit else "allow")
    assert {r.verdict for r in got if r.host == "hot.info"} == {by_url["hot.info", "/xyzzy"].verdict}
    assert len({by_url[k].verdict for k in by_url if k not in ruled}) == 2


def test_large_models_are_met_by_lookup(spark):
    table = spark.createDataFrame([(u,) for u in set(urls()) if u], "url string")
    host, path = url_lm.host_and_path(url_lm.F.col("url"))
    distinct = table.select(host.alias("host"), path.alias("path")).distinct()
    labelled = distinct.selectExpr("*", "if(host like '%com', 'block', 'allow') as verdict", "1L as n")
    model = url_lm.train(labelled, 3)
    a, b = ({(r.host, r.path): r.score for r in url_lm.score(distinct, model, 3, most_broadcast=m).collect()} for m in (10**6, 0))
    assert a == b and len(a) > 100


@pytest.mark.parametrize("hot", ["null", "text"])
def test_shards_keep_groups_and_split_hot_ones(spark, hot):
    """Equal texts share a shard; a text or null that half of the rows hold is split."""
    rng = np.random.default_rng(6)
    texts = [f"text {i % 400} " + "y" * int(rng.integers(5, 60)) * (i % 400 == i) for i in range(1200)]
    texts = [t if i < 400 else texts[i % 400] for i, t in enumerate(texts)]
    texts += [None if hot == "null" else "one hot text " * 4] * 1200 + ["z" * 300_000 if hot == "text" else ""]
    rows = [(i % 900 if i % 7 else None, t, i, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, key string")
    got = sharding.shard_by_bytes(docs, shards=4, ranges_per_shard=8, rows_per_range=40).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    hot_crc = zlib.crc32(("" if hot == "null" else "one hot text " * 4).encode())
    assert all(len(v) == 1 for k, v in where.items() if k != hot_crc)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    if hot == "null":
        assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())


def test_subdivide_by_rows():
    whole = [sharding.Range(sharding.LOW, sharding.HIGH), sharding.Range(5, 5)]
    cut = sharding.subdivide(whole, {0: (10, 1000), 1: (10, 1000)}, 100.0, 250, True)
    assert len(cut) == 5 and cut[-1] == sharding.Range(5, 5, 4)
    assert sharding.subdivide(whole, {0: (10, 10), 1: (150, 10)}, 100.0, 250, False) == whole


@pytest.mark.parametrize("most", [200_000, 0])
def test_archives_of_hot_payloads(spark, most, tmp_path):
    rows = [(i, f"u{i}", "the hot payload", i, "r") for i in range(300)] + [(i, None, None, i, "r") for i in range(300, 500)] + [(None, "n", "the hot payload", 1, "r"), (700, "x", "alone", 1, "r"), (701, "x", "é" * 100_000, 1, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int, record_type string").repartition(3)
    out = f"file://{tmp_path}/w"
    warc.write_warc(pages, out, most_broadcast=most)
    got = warc.read_warc(spark, out).collect()
    top = {"the hot payload": 299, "": 499, "alone": 700, "é" * 100_000: 701}
    want = Counter((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h, _, _ in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    few = f"file://{tmp_path}/few"
    warc.write_warc(pages, few, min_revisit_bytes=1, most_broadcast=most)
    assert Counter(r.record_type for r in warc.read_warc(spark, few).collect() if not r.payload_bytes) == {"response": 200}
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def test_tokens_of_hot_ids(spark, tmp_path):
    """Half of the rows have no doc_id, most others the same one."""
    texts = [f"word{i} of many, {i}" for i in range(40)] + ["long " * 40_000]
    rows = [(None if i % 2 else 7 if i % 4 else i, texts[i % 41], i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    out = f"file://{tmp_path}/t"
    manifest = token_output.write_tokens(docs, P.path("word_bpe_49k.json"), out).collect()
    assert sum(r.docs for r in manifest) == 600 and max(r.docs for r in manifest) < 400
    got = sorted(token_output.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = {t: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts}
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, coded[t]) for i, t, _ in rows)
