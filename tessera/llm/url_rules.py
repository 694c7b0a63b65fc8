"""URL filtering by association rules that Spark's FP-growth mines from labelled URLs.

1. Fixed rules (``host`` plus a path beginning) decide the URLs they fit; the
   longest wins.
2. Every URL becomes a small set of tokens: the ends of its host, the labels in
   front, its path segments, its extension and its query keys, all of them.
   Numbers count as one token.
3. FP-growth mines combinations that go with a label from the labelled URLs (by
   default those that a fixed rule decides).  Rules must reach ``support`` and
   ``confidence``; a rule is dropped if one with fewer tokens says the same at no
   less confidence.  A token that always goes with one label is a rule by itself,
   found by a plain count, and leaves before mining: every longer rule with it
   says no more.  Tokens that occur in just the same labelled URLs are mined as
   one and told apart again in the rules, which gives the same rules.
4. The rest of the URLs is matched through an inverted index from token to
   rules: a rule fits where all its tokens are met.  The most confident, then
   best supported, then longest rule decides (at a tie, block).  A URL that no
   rule fits is allowed.

URLs with equal token sets are judged once, so a host with a third of all pages
is one row in the index join; the verdict joins back to the pages on a hash
with an exchange of its own, which adaptive execution can split.  A URL has as
many tokens as its length gives; those below ``support`` leave before mining.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed.  Without labelled URLs of any label nothing is
mined.  Repeated rows are judged alike.  Extra columns are not looked at.  An
empty table yields an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialise, own_exchange

#: Fixed rules: (host and path beginning, verdict).
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    number = lambda c: F.when(c.rlike(r"^[0-9]+([._-].*)?$"), F.lit("#")).otherwise(c)
    labels = F.reverse(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.", -1))
    top = F.get(labels, F.lit(0))
    site = F.concat_ws(".", F.get(labels, F.lit(1)), top)
    front = F.slice(labels, 3, F.greatest(F.size(labels), F.lit(0)))
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.split(query, "[&;]", -1), lambda s: s != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("top:"), top), F.concat(F.lit("site:"), site)),
        F.transform(front, lambda s: F.concat(F.lit("host:"), number(s))),
        F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), number(s))),
        F.array(F.when(extension != "", F.concat(F.lit("ext:"), ascii_lower(extension)))),
        F.transform(keys, lambda s: F.concat(F.lit("key:"), F.substring_index(s, "=", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull())))


def _twins(labelled: DataFrame, support: float) -> DataFrame:
    """``token, rep``: the tokens that reach ``support``, and the first of those in just the same rows."""
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"))
    mark = lambda k: F.sum(F.xxhash64(F.lit(k), "tokens").cast("decimal(38,0)")).alias(f"x{k}")
    tokens = sets.select("tokens", "n", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), mark(0), mark(1)
    )
    # a little below the support, so that rounding never takes what FP-growth would keep
    tokens = materialise(tokens.filter(F.col("n") >= support * labelled.count() - 1), "frequent-tokens")
    reps = tokens.groupBy("n", "x0", "x1").agg(F.min("token").alias("rep"))
    return materialise(tokens.join(reps, ["n", "x0", "x1"]).select("token", "rep"), "twin-tokens")


def _sure_tokens(labelled: DataFrame, support: float) -> DataFrame:
    """``token, verdict, support`` of the tokens that reach ``support`` and go with one label only."""
    n = labelled.count()
    sets = labelled.groupBy("tokens", "label").agg(F.count("*").alias("n"))
    tokens = sets.select("label", "n", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.min("label").alias("verdict"), F.max("label").alias("other")
    )
    sure = tokens.filter((F.col("verdict") == F.col("other")) & (F.col("n") >= F.ceil(F.lit(support) * F.lit(n))))
    return materialise(sure.select("token", "verdict", F.round(F.col("n") / F.lit(n), 12).alias("support")), "sure-tokens")


def mine_rules(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """``rule_id, tokens, verdict, confidence, support`` from rows with ``tokens`` and ``label``.

    Twin tokens (in just the same rows) would double the frequent sets one by
    one, and a rule that holds two of them is always redundant.
    """
    label = lambda x: F.concat(F.lit("="), x)  # noqa: E731  no token begins like this
    sure = _sure_tokens(labelled, support)
    alone = sure.select(F.array("token").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), "support")
    taken = sure.select(F.array(F.col("token")).alias("t"))
    # rows over the support bound the tokens that reach it
    gone = F.broadcast(taken.agg(F.flatten(F.collect_list("t")).alias("gone")))
    labelled = labelled.crossJoin(gone).select(F.array_except("tokens", "gone").alias("tokens"), "label")
    labelled = materialise(labelled, "unsure-urls")
    twins = _twins(labelled, support)
    # rows over the support bound the frequent tokens: tokens a row / support
    first = F.broadcast(twins.agg(F.map_from_entries(F.collect_list(F.struct("token", "rep"))).alias("first")))
    short = labelled.crossJoin(first).select(
        "label",
        F.array_distinct(
            F.filter(F.transform("tokens", lambda t: F.element_at("first", t)), lambda t: t.isNotNull())
        ).alias("tokens"),
    )
    baskets = short.select(F.concat("tokens", F.array(label(F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = (
        model.associationRules.filter(F.startswith(F.get("consequent", F.lit(0)), F.lit("=")))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring(F.get("consequent", F.lit(0)), 2, 1000).alias("verdict"),
            F.round("confidence", 12).alias("confidence"),
            F.round("support", 12).alias("support"),
        )
        .filter(~F.exists("tokens", lambda t: F.startswith(t, F.lit("="))))
    )
    rules = materialise(rules.withColumn("rule_id", F.xxhash64(F.to_json(F.struct("tokens", "verdict")))), "rules")
    # a rule with fewer tokens that says the same at no less confidence makes a rule redundant
    tokens = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    less = tokens.select(*[F.col(c).alias(f"less_{c}") for c in tokens.columns])
    inside = (
        tokens.join(less, (F.col("t") == F.col("less_t")) & (F.col("verdict") == F.col("less_verdict")))
        .filter("less_n < n and less_confidence >= confidence")
        .groupBy("rule_id", "less_rule_id", "less_n")
        .count()
        .filter("count = less_n")
    )
    rules = rules.join(inside.select("rule_id").distinct(), "rule_id", "left_anti")
    # every choice of one twin for each token is a rule of its own
    twins = twins.groupBy("rep").agg(F.array_sort(F.collect_list("token")).alias("twins"))
    places = rules.select("rule_id", F.explode("tokens").alias("rep")).join(twins, "rep").groupBy("rule_id").agg(
        F.collect_list("twins").alias("choices")
    )
    none = F.array(F.array().cast("array<string>"))
    told = F.aggregate(
        "choices",
        none,
        lambda done, twin: F.flatten(F.transform(done, lambda d: F.transform(twin, lambda t: F.concat(d, F.array(t))))),
    )
    rules = rules.drop("tokens").join(places, "rule_id").withColumn("tokens", F.explode(told)).select(
        F.array_sort("tokens").alias("tokens"), "verdict", "confidence", "support"
    )
    rules = rules.unionByName(alone)
    return rules.withColumn("rule_id", F.xxhash64(F.to_json(F.struct("tokens", "verdict"))))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, verdict`` of the deciding rule for every row of ``sets`` (``key, tokens``) that a rule fits."""
    index = rules.select(
        "rule_id", "verdict", "confidence", "support", F.size("tokens").alias("n"), F.explode("tokens").alias("token")
    )
    met = (
        sets.select("key", F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("key", "rule_id", "n", "verdict", "confidence", "support")
        .count()
        .filter("count = n")
    )
    best = F.max(F.struct("confidence", "support", "n", "verdict"))  # "block" comes after "allow"
    return met.groupBy("key").agg(best.alias("best")).select("key", F.col("best.verdict").alias("verdict"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    labels: DataFrame | None = None,
    support: float = 0.005,
    confidence: float = 0.8,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (fixed, else null), ``verdict``.

    ``labels`` (url, label) teaches the miner; without it the URLs that a fixed
    rule decides do.
    """
    url = F.col("url")
    parsed = (
        pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
        .withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("tokens", F.when(F.col("host") != "", url_tokens(url, F.col("host"), F.col("path"))))
        .withColumn("h", F.xxhash64("tokens"))
        .select("id", "host", "path", "fixed", "tokens", "h")
    )
    if labels is None:
        taught = parsed.filter("fixed is not null and tokens is not null").select(
            "tokens", F.col("fixed.verdict").alias("label")
        )
    else:
        given = F.col("url")
        taught = labels.select(F.col("url").cast("string").alias("url"), "label").filter("label is not null").select(
            url_tokens(given, host_of(given), path_of(given)).alias("tokens"), "label"
        )
    taught = materialise(taught, "labelled-urls")
    sets = parsed.filter("tokens is not null").groupBy("tokens").agg(F.first("h").alias("h"))
    sets = sets.select("h", "tokens", F.to_json("tokens").alias("key"))
    mined = None if taught.isEmpty() else mine_rules(taught, support, confidence)
    if mined is None:
        judged = sets.select("h", "key", F.lit("allow").alias("learned"))
    else:
        verdicts = match_rules(sets, mined)
        judged = sets.select("h", "key").join(verdicts, "key", "left").select(
            "h", "key", F.coalesce("verdict", F.lit("allow")).alias("learned")
        )
    judged = judged.select(own_exchange(F.col("h")).alias("h"), "key", "learned")
    out = parsed.withColumn("key", F.to_json("tokens")).join(judged, ["h", "key"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "learned", F.lit("allow")).alias("verdict"),
    )
