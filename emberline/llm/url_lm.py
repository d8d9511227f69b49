"""URL filters: host and path rules, and for the rest a ratio of two character language
models, in DataFrame functions alone.

The models are variable-order Markov models of the URLs that the rules allow and those
they block. A character's chance after its context of k characters is smoothed by
Witten and Bell's estimate with the chance after the context of k - 1, down to a fixed
alphabet. A position is judged by the longest context (up to `order`) after which its
character was seen in either model. A URL is blocked if its mean log ratio exceeds a
threshold that is calibrated on labelled URLs kept from training.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..operators.storage import discard
from .common import written

#: The query's rules: (verdict, rule); a rule is a host and the path's beginning.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
ALPHABET = 256.0
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a URL: what follows the first :// up to / ? # or the end, A-Z in lower case; and
    from there up to ? # or the end. Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and
    all subdomains if the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character and the end of each (host, path), with g0..g{order}: the
    character behind its context of 0 to order characters, null where there are fewer."""
    text = urls.withColumn("s", F.concat(F.lit(START), "host", "path", F.lit(END)))
    at = text.withColumn("i", F.explode(F.sequence(F.lit(2), F.length("s"))))
    grams = [F.when(F.col("i") > k, F.substring("s", F.col("i") - k, F.lit(k + 1))).alias(f"g{k}") for k in range(order + 1)]
    return at.select(*urls.columns, *grams)


def train(labelled: DataFrame, order: int = 4) -> DataFrame:
    """(k, gram, ratio) from rows (host, path, verdict, n), n being a URL's rows: for every
    character seen after a context of k characters the log of its chance in the blocked
    model over that in the allowed one. Counts are over all rows."""
    grams = _positions(labelled, order)
    stacked = grams.select("verdict", "n", F.posexplode(F.array(*(f"g{k}" for k in range(order + 1)))).alias("k", "gram")).where("gram is not null")
    side = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    counts = written(stacked.groupBy("k", "gram").agg(side("allow").alias("a"), side("block").alias("b")), "counts")
    below = None
    out = []
    for k in range(order + 1):
        own = counts.where(F.col("k") == k).withColumn("context", F.expr("left(gram, length(gram) - 1)"))
        sums = own.groupBy("context").agg(*(f(x).alias(f"{x}_{n}") for x in "ab" for n, f in (("all", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))))
        own = own.join(sums, "context")
        if below is None:
            own = own.withColumns({f"low_{x}": F.lit(1 / ALPHABET) for x in "ab"})
        else:
            less = below.select(F.col("gram").alias("shorter"), F.col("p_a").alias("low_a"), F.col("p_b").alias("low_b"))
            own = own.join(less, F.expr("substring(gram, 2)") == F.col("shorter"))
        chance = lambda x: F.when(F.col(f"{x}_all") == 0, F.col(f"low_{x}")).otherwise((F.col(x) + F.col(f"{x}_kinds") * F.col(f"low_{x}")) / (F.col(f"{x}_all") + F.col(f"{x}_kinds")))
        below = written(own.select("k", "gram", chance("a").alias("p_a"), chance("b").alias("p_b")), "chances")
        out.append(below)
    model = out[0]
    for t in out[1:]:
        model = model.unionByName(t)
    return model.select("k", "gram", F.log(F.col("p_b") / F.col("p_a")).alias("ratio"))


def _ratios(grams: DataFrame, model: DataFrame, order: int, most: int) -> DataFrame:
    """grams (g0..g{order}, ...) with r: the ratio of the longest gram in the model, 0 if
    there is none. A length's part of the model is broadcast up to `most` rows, else met by
    a shuffle."""
    for k in range(order + 1):
        own = model.where(F.col("k") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        grams = grams.join(F.broadcast(own) if own.count() <= most else own, f"g{k}", "left")
    best = F.coalesce(*(F.col(f"r{k}") for k in range(order, -1, -1)), F.lit(0.0))
    return grams.withColumn("r", best)


def score(urls: DataFrame, model: DataFrame, order: int = 4, most_broadcast: int = 200_000) -> DataFrame:
    """(host, path, score) for the distinct (host, path) in urls: the mean log ratio by
    position; a character that neither model has seen counts as 0. A model of up to
    most_broadcast rows (of about 60 bytes) is broadcast. Beyond that, the distinct longest
    grams of all positions meet the model, each once, and positions get theirs by lookup,
    as a few grams are most of all positions."""
    at = _positions(urls.select("host", "path"), order)
    if model.count() <= most_broadcast:
        scored = _ratios(at, model, order, most_broadcast)
    else:
        grams = [f"g{k}" for k in range(order + 1)]
        longest = F.coalesce(*(F.col(g) for g in reversed(grams))).alias("longest")
        distinct = written(at.select(longest, *grams).groupBy("longest").agg(F.count("*").alias("n"), *(F.first(g).alias(g) for g in grams)), "grams")
        total = distinct.agg(F.sum("n")).first()[0] or 0
        found = written(_ratios(distinct, model, order, most_broadcast).select("longest", "r", "n"), "ratios")
        scored = lookup(at.select("host", "path", longest), found, ["longest"], total=total)
    return scored.groupBy("host", "path").agg(F.round(F.avg("r"), 9).alias("score"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, *, order: int = 4, false_blocks: float = 0.01, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row.

    The verdict is the longest fitting rule's; else block if the models' score exceeds
    the threshold, which leaves `false_blocks` of the allowed URLs that were kept from
    training above it (0 if there were none), and allow otherwise. A URL with neither host
    nor path (null, or without ://) is allowed and has no score, and so are all others if
    no rule has labelled any. Null or repeated ids and equal rows stay, a verdict for
    each; an empty table gives an empty result; other columns are not read. Of rules that
    fit, no two are equally long but the same. URLs are scored once each, a very long one
    by a row for each of its characters. Only rows that no rule decides meet the scores,
    by lookup, so a URL that many rows share isn't gathered anywhere.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    urls = written(parsed.groupBy("host", "path").agg(F.count("*").alias("n")).withColumns({"rule": rule, "verdict": verdict}), "urls")
    labelled = urls.where("verdict is not null")
    kept = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    model = written(train(labelled.where(~kept), order), "model")
    open_urls = urls.where("host <> '' or path <> ''").where(F.col("verdict").isNull() | (kept & (F.col("verdict") == "allow")))
    scores = written(open_urls.join(score(open_urls, model, order), ["host", "path"]), "scores")
    calm = scores.where("verdict is not null").agg(F.percentile_approx("score", 1 - false_blocks, 10_000)).first()[0]
    limit = 0.0 if calm is None else calm
    open_scores = written(scores.where("verdict is null").select("host", "path", "score", "n"), "open_scores")
    said = parsed.withColumns({"rule": rule, "ruled": verdict})
    asked = F.col("ruled").isNull() & ((F.col("host") != "") | (F.col("path") != ""))
    total = open_scores.agg(F.sum("n")).first()[0] or 0
    scored = lookup(said.where(asked), open_scores, ["host", "path"], total=total)
    rest = said.where(~asked).withColumn("score", F.lit(None).cast("double"))
    discard(urls, model, scores)
    own = F.when(F.col("score") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return scored.unionByName(rest).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
