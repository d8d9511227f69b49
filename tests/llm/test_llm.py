import zlib
from collections import Counter

import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from near_copies import brute_near_groups, five_word_sets

from emberline.llm import byte_bpe, decontam, langid, quality, sharding, simhash, token_count, token_output, url_lm, warc

ODD = [None, "", " ", "a", "Don't stop, now.", "x\x1cy\x85z  q\n\n r ", "a" * 3000, "<|endoftext|> <|EndOfText|>", "ΣΑΣ İstanbul é 你好 🎉", "one two three four five six seven", "one two three four five six seven"]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens int, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    return spark.createDataFrame([(i, t, None if n % 2 else "en", None, n, "x") for n, (i, t) in enumerate(zip(ids, ODD, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_tokens(spark, odd, none, docs):
    path, tok = P.path("word_bpe_49k.json"), library()
    for table in (odd, docs):
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        want, start = [], 0
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in token_output.token_output(table, path).collect()), key=lambda r: r[1])
        assert got == want
        counts = Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in token_count.token_counts(table, path).collect())
        assert counts == Counter((i, len(tok.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in rows)
    assert token_output.token_output(none, path).count() == 0 and token_count.token_counts(none, path).count() == 0


def test_byte_bpe(odd, none, docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (odd, docs):
        want = Counter((r.doc_id, tuple(own.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in table.collect())
        got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in byte_bpe.encode_texts(table, path, P.PATTERN).collect())
        assert got == want
    assert byte_bpe.encode_texts(none, path, P.PATTERN).count() == 0


def brute_components(prints, distance):
    near = np.bitwise_count(prints[:, None] ^ prints) <= distance
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("distance", "most"), [(1, 1), (2, 1), (3, 1), (4, 8192), (4, 3), (4, 1), (5, 1), (5, 8192)])
def test_near_edges_keep_components(spark, distance, most):
    rng = np.random.default_rng(distance)
    centers = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    prints = [c for c in centers]
    for c in centers:
        for _ in range(4):
            x = c
            for b in rng.choice(64, rng.integers(1, distance + 3), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            prints.append(x)
        prints.append(prints[-1] ^ np.uint64((1 << distance) - 1 << 20))  # just linked
    prints = np.unique(np.array(prints, np.uint64).view(np.int64))
    edges = simhash.near_edges(spark.createDataFrame([(int(x),) for x in prints], "fp long"), distance, most=most)
    root = {int(x): int(x) for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges.collect():
        a, b = find(r.u), find(r.v)
        root[max(a, b)] = min(a, b)
    label = brute_components(prints.view(np.uint64), distance)
    assert [find(int(x)) for x in prints] == [int(prints[i]) for i in label]


def test_fingerprints_by_brute_force(spark, odd, docs):
    """Fingerprints bit by bit and components over all pairs, for odd texts and a hot one
    that half of the rows hold."""
    import re

    import xxhash

    def fingerprint(text):
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles = [" ".join(own[i : i + 4]) for i in range(max(len(own) - 3, 1))] if own else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    some = docs.select("doc_id", "text")
    hot = spark.range(1000, 1300).selectExpr("id as doc_id", "'One hot text, of many rows ' as text")
    for table in (odd.select("doc_id", "text"), some.union(hot)):
        rows = table.collect()
        prints = {r.text: fingerprint(r.text) for r in rows}
        distinct = np.array(sorted(set(prints.values())), np.uint64)
        label = dict(zip(distinct.tolist(), brute_components(distinct, 4), strict=True))
        least = {}
        for r in rows:
            if r.doc_id is not None:
                c = label[prints[r.text]]
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        want = Counter((r.doc_id, prints[r.text], least.get(label[prints[r.text]])) for r in rows)
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(table).collect()) == want


def test_simhash(odd, none):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD)
    nine = [r for r in rows if r.doc_id == 9]
    assert len(nine) == 2 and nine[0].component_id == nine[1].component_id == 9
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert simhash.simhash_components(none).count() == 0 and simhash.one_of_each(none).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def test_language(spark, odd, none, docs):
    model = langid.train(docs.where(~langid.held_out()))
    got = langid.identify(docs, model).where("held_out").join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and [r.lang_pred for r in rows if r.doc_id == 1] == ["und"]
    empty = langid.train(none)
    assert langid.identify(none, model).count() == 0 and {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_letters():
    assert langid.word_list("½ ² ① Ⅷ 12 _ \u0301") == []
    assert langid.word_list("X²y ½é 日本五 ÀB1c Ж") == ["x", "y", "é", "日本五", "àb", "c", "ж"]


def test_filter_is_nearly_exact_sets(spark, docs):
    """The filter has every n-gram that exact counts give a language, and few others."""
    known = [(r.text, r.lang) for r in docs.where(~langid.held_out()).collect() if r.text and r.lang]
    counts = {}
    for text, lang in known:
        for w in langid.word_list(text):
            counts.setdefault(lang, Counter()).update(langid.grams(w))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = {}
    for own in share.values():
        for g, p in own.items():
            top[g] = max(top.get(g, 0), p)
    sets = {x: {g for g, p in own.items() if p >= 0.5 * top[g]} for x, own in share.items()}
    model = langid.train(docs.where(~langid.held_out()))
    keys = sorted(top)
    has = model.contains(keys)
    assert model.langs == sorted(sets) and len(keys) > 1000
    for i, x in enumerate(model.langs):
        exact = np.array([k in sets[x] for k in keys])
        assert has[exact, i].all() and has[~exact, i].mean() < 0.01
    rows = spark.createDataFrame([(1, "½ ² ①"), (2, "12 34"), (3, "the ½")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(rows, model).collect()} == {1: "und", 2: "und", 3: "en"}
    few = langid.train(docs, most_rows=100)
    got = langid.identify(docs, few).join(docs, "doc_id").where("lang is not null")
    assert got.where("lang = lang_pred").count() > 0.9 * got.count()


def test_quality(spark, odd, none, docs):
    for r in quality.quality_verdicts(docs).collect():
        words = next(d for d in [r]).n_words
        assert r.base_failed == (words < 10 or 100 * r.n_repeat_words > 20 * words) and (not r.kept or not r.base_failed)
    text = "a b c d e f a b c d e g\nline one\nline one\n\n#&"
    own = text.split()
    windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {p for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for p in range(i, i + 5)}
    assert quality.text_stats(text) == (17, sum(map(len, own)), 2, 1, len(covered), 4)
    assert quality.quality_verdicts(odd).count() == len(ODD) and quality.quality_verdicts(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_sharding(odd, none, docs):
    for table in (odd, docs):
        rows = sharding.shard_by_bytes(table, shards=4).collect()
        assert len(rows) == table.count()
        by = {s: sorted(r.slot for r in rows if r.shard == s) for s in {r.shard for r in rows}}
        assert all(v == list(range(len(v))) for v in by.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 4
    assert sharding.shard_by_bytes(none).count() == 0


def brute_matches(docs, items):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if w else Counter()
    out = {}
    for d, t in docs:
        own = words(t)
        for i, u in items:
            item = words(u)
            n = min(len(item), len(own))
            best = 0.0
            for a in range(len(own) - n + 1) if n else ():
                x, y = shingles(own[a : a + n]), shingles(item)
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(spark, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    item = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, item(n)) for i, n in enumerate((30, 45, 60, 60, 3))]
    texts = []
    for k in range(40):
        words = item(int(rng.integers(20, 80)))
        own = list(items[k % 5][1])
        for _ in range(k // 10):
            own[int(rng.integers(len(own)))] = "changed"
        at = int(rng.integers(len(words)))
        texts.append((k, " ".join(words[:at] + own + words[at:])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(9, None)], "item_id long, text string")
    table = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(table, bench).collect()}
    want = brute_matches(texts, [(i, " ".join(w)) for i, w in items])
    assert got == want and len(want) > 10
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(table, bench.where("false")).count() == 0
    assert decontam.keep_clean(table, bench).count() == 41 - len({d for d, _ in want})


def test_url_rules(spark):
    urls = ["https://A.Example.COM/en/7?x", "http://b.com/en/1#t", "https://x.net/de/", "nothing", None, "ftp://example.net/de/85", "://", "http://EN.org?es/", "http://x.org/es/1", "http://x.org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_lm.judge_urls(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[1] == ("b.com", "/en/1", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2] == "example.net/de/8" and got[7][:3] == ("en.org", "", None) and got[9][3] == "block"
    assert url_lm.judge_urls(pages.where("false")).count() == 0


def test_url_rules_are_the_contract_s(spark):
    """Each rule's word, by a URL that it decides."""
    said = {"a.com/en/": "block", "example.com/en/7": "allow", "x.net/de/": "allow", "www.example.net/de/81": "block", "example.net/de/7": "allow", "x.org/es/1": "block"}
    pages = spark.createDataFrame(list(enumerate(f"http://{u}" for u in said)), "page_id long, url string")
    assert [r.verdict for r in url_lm.judge_urls(pages).orderBy("page_id").collect()] == list(said.values())


def test_url_model(spark):
    rows = [("a.com", "/x1", "allow", 2), ("b.com", "/y", "block", 1)]
    got = {(r.k, r.gram): r.ratio for r in url_lm.train(spark.createDataFrame(rows, "host string, path string, verdict string, n long"), 2).collect()}

    def chance(verdict, gram):
        texts = [("\x02" + h + p + "\x03", n) for h, p, v, n in rows if v == verdict]
        if not gram:
            return 1 / 256
        context, seen = gram[:-1], Counter()
        for t, n in texts:
            for i in range(1, len(t)):
                if i >= len(context) and t[i - len(context) : i] == context:
                    seen[t[i]] += n
        low = chance(verdict, gram[1:]) if context else 1 / 256
        total, kinds = sum(seen.values()), len(seen)
        return (seen[gram[-1]] + kinds * low) / (total + kinds) if total else low

    assert len(got) > 20
    for (_, gram), ratio in got.items():
        assert ratio == pytest.approx(np.log(chance("block", gram) / chance("allow", gram)))


def test_warc(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u", "same"), (5, "u", "same"), (None, None, None), (2, "v", ""), (3, "w\r\n", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    warc.write_warc(pages, out)
    got = warc.read_warc(spark, out).collect()
    assert len(got) == 6 and sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted(["same", "", "é" * 500])
    same = [r for r in got if r.payload_digest == warc.digest(b"same")]
    assert sorted((r.page_id, r.refers_to, r.record_type) for r in same if r.record_type == "revisit") == [(1, 5, "revisit"), (5, 5, "revisit")]
    assert {(r.page_id, r.refers_to) for r in got if r.payload_bytes == 0} == {(2, None), (None, 2)}
    import io

    good = warc.record_bytes(uid=1, page_id=1, url="u", payload=b"abc")
    assert [r.payload for r in warc.read_records(io.BytesIO(good + good), chunk=7)] == [b"abc", b"abc"]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-9])))


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_decisions_hold_for_other_splits(spark, tmp_path):
    """Rows are removed by a read that cuts the files in another way than the first one."""
    words = np.random.default_rng(5).integers(0, 10**6, (300, 40))
    texts = [" ".join(f"w{x}" for x in words[i % 200]) for i in range(300)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(i, None, "en", "a") for i in range(300, 330)]
    for n in range(6):
        spark.createDataFrame(rows[n::6], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/t{n}")
    docs = spark.read.parquet(*(f"file://{tmp_path}/t{n}" for n in range(6)))
    for remove in (simhash.one_of_each, quality.keep_good):
        want = sorted((r.doc_id, r.text) for r in remove(docs).collect())
        later = remove(docs)
        before = spark.conf.get("spark.sql.files.openCostInBytes")
        try:
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            got = sorted((r.doc_id, r.text) for r in later.collect())
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", before)
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert got == want and 0 < len(got) < 330
    assert len({t for _, t in sorted((r.doc_id, r.text or "") for r in simhash.one_of_each(docs).collect())}) == 201


def test_one_of_each_by_brute_force(spark):
    """Pairs of all similarities, close to 0.8 above all; chains; a common passage."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(12)]
    texts = [None, "", "one", "one", "a b c d e f", "a b c d e g"]
    for n in (*[30] * 40, *[64] * 60, *[204] * 60):
        base = [f"w{x}" for x in rng.integers(0, 10**7, n)]
        texts.append(" ".join(passage + base))
        for _ in range(2):
            copy = list(base)
            for at in rng.choice(n, max(1, int(n * rng.uniform(0.002, 0.05))), replace=False):
                copy[at] = f"x{rng.integers(0, 10**7)}"
            texts.append(" ".join(passage + copy))
            base = copy if rng.random() < 0.5 else base
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    root = brute_near_groups(texts)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))
    assert 0.3 * len(texts) < len(set(root)) < 0.9 * len(texts)
    share = lambda a, b: len(a & b) / len(a | b)
    sets = five_word_sets(texts)
    near = [share(sets[i], sets[i + 1]) for i in range(6, len(sets) - 1)]
    assert sum(0.7 <= x < 0.8 for x in near) > 10 and sum(0.8 <= x < 0.85 for x in near) > 10


def test_stages_drop_what_their_operators_reject(spark):
    """The first two stages keep the rows that the operators' own results name, repeats and
    other columns included; both decisions are made over the stage's whole input."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"n_words": F.lit(1), "lang_pred": F.lit("x")})
    docs = docs.union(docs.where("doc_id % 10 = 0"))
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = Counter(r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect())
    assert Counter(r.doc_id for r in good.collect()) == kept and good.columns == docs.columns
    spoken = corpus_pipeline.language_id(spark, docs, sf_dir)
    found = langid.identify(docs, langid.train(docs.where(~langid.held_out()))).where("lang_pred <> 'und' and score >= 0.25")
    assert Counter(r.doc_id for r in spoken.collect()) == Counter(r.doc_id for r in found.collect()) and spoken.columns == docs.columns
    rest = Counter(r.doc_id for r in docs.collect()) - kept
    assert rest and all(r.base_failed or r.distance2 > 23.5 for r in quality.quality_verdicts(docs).where("not kept").collect())


def test_pipeline_rows(spark):
    """run() keeps one document of each group of near copies, found by brute force, that
    has no passage of the benchmark."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.language_id(spark, corpus_pipeline.quality_rules(spark, docs, sf_dir), sf_dir).collect()
    root = brute_near_groups([r.text for r in good])
    group = {r.doc_id: g for r, g in zip(good, root, strict=True)}
    assert len(group) == len(good) > len(set(root))
    bad = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    got = Counter(group[r.doc_id] for r in corpus_pipeline.run(spark, sf_dir).collect())
    for g in set(root):
        marks = {d in bad for d, x in group.items() if x == g}
        assert got[g] in ({0, 1} if len(marks) == 2 else {0} if marks == {True} else {1})
