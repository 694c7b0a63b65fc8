"""Connected components by alternating large-star and small-star steps (DataFrame joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, own_exchange


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(own_exchange(F.col("u")).alias("u"), "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (columns ``u``, ``v``).

    Each round materialises the edge list, so its length is bounded by the
    input's and the lineage stays short.  The minimum per node is a partial
    aggregate; a hub's edges meet it in a join that adaptive execution splits.
    An edge list that does not settle in ``max_rounds`` is an error.
    """
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    current = materialise(current, "cc")
    seen = None
    for _ in range(max_rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_lowest(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        lowest = large.join(_lowest(large), "u")
        small = lowest.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
        current = materialise(small.filter("u <> v").distinct(), "cc")
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
