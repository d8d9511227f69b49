"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_lm import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digest=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out())))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    conv = F.col("conv_id")
    found = prefix_trie(table(spark, sf_dir, "conversations"), fork_from=conv - conv % 5, fork_at=F.crc32(conv.cast("string").cast("binary")) % 9)
    return found.drop("text_file", "text_row")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vec = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, vec % 50 == 0)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, ("assign", "access", "hex", "guess")))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), said(F.col("spans")).alias("spans"), "n_guess")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (strpos('0123456789abcdef', substr(x, (i * 5) // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(x, (i * 5) // 4 + 2, 1)) - 1) >> (3 - (i * 5) % 4)) % 32)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

OP11_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
forks AS (SELECT s.c, s.c - s.c % 5 AS p, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(s.c::VARCHAR) + 1), lambda i: ascii(substr(s.c::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM size s),
heads AS (SELECT f.c, f.p, f.h, least(f.h, coalesce(o.n, 0)) AS k FROM forks f LEFT JOIN size o ON o.c = f.p),
turns AS (SELECT f.c, t.pos AS d, r, x FROM heads f JOIN t ON t.c = f.p AND t.pos <= f.h
  UNION ALL SELECT f.c, f.k + t.pos - f.h, r, x FROM heads f JOIN t ON t.c = f.c AND t.pos > f.h),
prefixes AS (SELECT c, d, strlen(x) AS b, list(struct_pack(r := r, x := x)) OVER (PARTITION BY c ORDER BY d) AS k FROM turns
  UNION ALL SELECT c, 0, 0, [] FROM heads),
members AS (SELECT c, d, b, min(c) OVER w AS rep, count(*) OVER w AS n, max(d) OVER (PARTITION BY c) AS top
  FROM prefixes WINDOW w AS (PARTITION BY d, k)),
nodes AS (SELECT m.c, m.d, m.n, m.b, p.rep AS parent FROM members m LEFT JOIN members p ON p.c = m.c AND p.d = m.d - 1 WHERE m.c = m.rep),
kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT v.c, v.d, (v.n - 1) * v.b AS saved, (k.n IS NULL)::BIGINT AS leaf FROM nodes v LEFT JOIN kids k USING (c, d)),
sums AS (SELECT m.rep AS c, m.d, sum(o.leaf) AS leaves, sum(o.saved) AS saved FROM members m JOIN own o ON o.c = m.c AND o.d >= m.d GROUP BY ALL),
ends AS (SELECT rep AS c, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM members WHERE d = top GROUP BY ALL)
SELECT v.c::BIGINT AS conv_id, v.d::BIGINT AS depth, v.parent::BIGINT AS parent_conv_id, v.n::BIGINT AS n_convs,
  coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN sums s USING (c, d) LEFT JOIN kids k USING (c, d) LEFT JOIN ends e USING (c, d)
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS uid
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.uid AS a, a.vec_id AS anchor_id, r.uid AS r, r.vec_id AS id, a.label = r.label AS alike, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.uid <> r.uid),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, r) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.id, n.r)
QUALIFY row_number() OVER w <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secrets": op13_secrets,
}

ORACLES: dict[str, str] = {"op10_warc": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
