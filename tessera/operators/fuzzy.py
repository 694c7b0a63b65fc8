"""Fuzzy key remapping (J10) and field-mapping suggestion (P2), exact.

Each distinct related key is remapped to the most similar distinct main key
when the Ratcliff-Obershelp score reaches the threshold; ties go to the main
key seen first.  No pair is scored unless it can reach the threshold, and
the answer equals the full search:

1. exact matches (score 100, unbeatable) are resolved by an equi-join and
   removed with ``left_anti``;
2. the matched characters ``M`` of a pair are at most the overlap of the two
   strings' character multisets, and the threshold needs
   ``M >= ceil(tau*(|a|+|b|)/2)``.  Each string becomes a set of tokens
   (character, occurrence number), ordered globally from rarest to most
   common; by the prefix-filtering argument two strings whose overlap reaches
   ``t`` share a token among the first ``|s| - t + 1`` tokens of each.  Each
   side uses a lower bound of ``t`` valid for every partner length the length
   band allows, so candidates are pairs that share a prefix token: an
   equi-join on the token instead of all pairs;
3. the places of the first shared token bound the overlap: behind place ``i`` of
   one and ``j`` of the other at most ``1 + min(|a| - i, |b| - j)`` tokens are
   shared.  Pairs that no shared token lets reach ``t``, or whose lengths lie
   outside the band (``M <= min(|a|, |b|)``), are dropped in the join, before
   anything is shuffled or made distinct; the vectorised scorer checks the two
   quick upper bounds before the full match;
4. ``max_by(main, struct(score, -first_rank))`` picks the winner per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import normalize_field_name, normalized_name, similarity
from tessera.operators.ordinals import dense_index

_EPS = 1e-9
_TOKEN_SEP = "\u0001"


def _floor_tau(tau: float) -> float:
    return max(tau - _EPS, _EPS)


def _band(length: Column, tau: float) -> tuple[Column, Column]:
    """Partner lengths a pair can have and still reach ``tau`` (rounded outward)."""
    low = _floor_tau(tau)
    lo = F.floor(length * F.lit(low / (2.0 - low)))
    hi = F.ceil(length * F.lit((2.0 - low) / low))
    return F.greatest(lo, F.lit(1)).cast("int"), hi.cast("int")


def _tokens(strings: DataFrame, col: str) -> DataFrame:
    """(string, token): each character numbered by its occurrence, so the
    multiset overlap of two strings is the size of their token intersection."""
    chars = F.split(F.col(col), "")
    # one pass over the text for each different character in it
    numbered = F.transform(
        F.array_distinct(chars),
        lambda x: F.transform(
            F.sequence(F.lit(1), F.size(F.filter(chars, lambda y: y == x))),
            lambda k: F.concat(x, F.lit(_TOKEN_SEP), k.cast("string")),
        ),
    )
    return strings.select(col, F.explode(F.flatten(numbered)).alias("tok"))


def _prefix_tokens(strings: DataFrame, col: str, ranks: DataFrame, tau: float) -> DataFrame:
    """(string, token, its place from 1) for the rarest ``|s| - t + 1`` tokens of each string."""
    low = _floor_tau(tau)
    n = F.length(F.col(col))
    lo, _hi = _band(n, tau)
    need = F.greatest(F.lit(1), F.floor(F.lit(low) * (n + lo) / 2)).cast("int")
    ranked = _tokens(strings, col).join(ranks, "tok")
    per_string = ranked.groupBy(col).agg(F.array_sort(F.collect_list(F.struct("freq", "tok"))).alias("_toks"))
    prefix = F.slice(F.col("_toks"), 1, F.greatest(F.lit(1), n - need + 1))
    return per_string.select(col, F.posexplode(prefix).alias("_at", "_t")).select(
        col, F.col("_t.tok").alias("tok"), (F.col("_at") + 1).alias(f"{col}_at")
    )


def candidate_pairs(qs: DataFrame, cs: DataFrame, tau: float) -> DataFrame:
    """(q, c): the pairs of distinct strings that may reach ``tau``; every pair that does is among them."""
    # token frequency over both sides: the global order is rarest first
    ranks = (
        _tokens(qs, "q").select("tok").unionByName(_tokens(cs, "c").select("tok"))
        .groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    )
    m, n = F.length("q"), F.length("c")
    lo, hi = _band(m, tau)
    need = F.ceil(F.lit(_floor_tau(tau)) * (m + n) / 2 - F.lit(_EPS))
    reach = F.least(m - F.col("q_at"), n - F.col("c_at")) + 1
    shared = _prefix_tokens(qs, "q", ranks, tau).join(_prefix_tokens(cs, "c", ranks, tau), "tok")
    return shared.filter(n.between(lo, hi) & (reach >= need)).select("q", "c").distinct()


def best_matches(
    queries: DataFrame,
    candidates: DataFrame,
    threshold_ratio: float,
    scale: float = 1.0,
) -> DataFrame:
    """For each query string ``q`` the best candidate ``c`` with ``ratio(q, c)*scale >= threshold``.

    ``queries``: (q string); ``candidates``: (c string, rank long) with rank the
    tie order.  Returns (q, c, score) for queries that found a partner.
    """
    tau = threshold_ratio
    qs = queries.select("q").filter(F.length("q") > 0).distinct()
    cs = candidates.filter(F.length("c") > 0)
    distinct_c = cs.select("c").distinct()
    pairs = candidate_pairs(qs, distinct_c, tau)
    scored = pairs.join(cs, "c").select(
        "q", "c", "rank", (similarity("q", "c", floor=max(tau - _EPS, 0.0)) * F.lit(scale)).alias("score")
    )
    best = scored.groupBy("q").agg(
        F.max("score").alias("score"),
        F.max_by("c", F.struct(F.col("score"), -F.col("rank"))).alias("c"),
    )
    return best.filter(F.col("score") >= F.lit(threshold_ratio * scale))


def fuzzy_key_map(main_keys: DataFrame, related_keys: DataFrame, threshold: float) -> DataFrame:
    """J10 mapping ``(key, target)`` for related keys that move to another main key.

    ``main_keys``: (key, first) one row per distinct non-empty main key with its
    first-appearance order; ``related_keys``: (key) distinct non-empty.
    ``threshold`` is on the 1..100 scale.
    """
    if not 0 < threshold <= 100:
        raise ValueError("Fuzzy threshold must be in 1..100")
    ranked = dense_index(main_keys, ["first"], name="rank").select(F.col("key").alias("c"), "rank")
    rest = related_keys.select(F.col("key").alias("q")).join(
        ranked.select(F.col("c").alias("q")), "q", "left_anti"
    )
    best = best_matches(rest, ranked, threshold / 100.0, scale=100.0)
    return best.select(F.col("q").alias("key"), F.col("c").alias("target"))


def suggest_field_mapping(
    spark: SparkSession,
    source_fields: Sequence[str],
    target_fields: Sequence[str],
    threshold: float = 0.72,
) -> DataFrame:
    """For each source field the most similar target field by normalised
    name; kept when the score reaches ``threshold`` and the names differ.

    Returns (source, target, score).  Names are schema metadata, so the name
    lists come from the driver; the pairing runs as the same banded join.
    """
    src = spark.createDataFrame(
        [(s, normalize_field_name(s)) for s in dict.fromkeys(source_fields)], "source string, q string"
    )
    tgt = spark.createDataFrame(
        [(t, normalize_field_name(t), i) for i, t in enumerate(target_fields)],
        "target string, c string, rank long",
    )
    best = best_matches(src.select("q").distinct(), tgt.select("c", "rank"), threshold)
    # several targets may share a normalised name: the earliest one wins
    first_target = tgt.groupBy("c").agg(F.min_by("target", "rank").alias("target"))
    out = src.join(best, "q").join(first_target, "c")
    return out.filter(F.col("source") != F.col("target")).select("source", "target", "score")


FIELD_ROWS = "table string, field string, position long"


def suggest_field_mappings(fields: DataFrame, targets: DataFrame, threshold: float = 0.72) -> DataFrame:
    """P2 for many tables: ``fields`` and ``targets`` are schemas as rows (``table, field, position``).

    For every field and every target table of another name, the most similar
    target field by normalised name, the earliest at a tie; kept when the score
    reaches ``threshold`` and the names differ.  Equal names are scored once, in
    one similarity join for all tables.

    Returns (source_table, source, target_table, target, score).
    """
    named = lambda df: df.withColumn("_n", normalized_name(F.col("field")))
    src = named(fields).select(F.col("table").alias("source_table"), F.col("field").alias("source"), F.col("_n").alias("q"))
    tgt = named(targets).select(
        F.col("table").alias("target_table"), F.col("field").alias("target"), F.col("_n").alias("c"), "position"
    )
    qs, cs = [df.select(k).filter(F.length(k) > 0).distinct() for df, k in ((src, "q"), (tgt, "c"))]
    scored = candidate_pairs(qs, cs, threshold).withColumn("score", similarity("q", "c", floor=max(threshold - _EPS, 0.0)))
    scored = scored.filter(F.col("score") >= F.lit(threshold))
    pairs = src.distinct().join(scored, "q").join(tgt, "c").filter(F.col("source_table") != F.col("target_table"))
    best = pairs.groupBy("source_table", "source", "target_table").agg(
        F.max_by(F.struct("target", "score"), F.struct(F.col("score"), -F.col("position"))).alias("_b")
    )
    return best.select("source_table", "source", "target_table", "_b.target", "_b.score").filter(F.col("source") != F.col("target"))


def schema_rows(spark: SparkSession, tables: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Schemas (table, field names) as rows for ``suggest_field_mappings``."""
    return spark.createDataFrame([(t, f, i) for t, names in tables for i, f in enumerate(names)], FIELD_ROWS)
