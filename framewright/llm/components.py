"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _nearest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """edges with m, the least of key and all others at that key; written, so that a hot key's join can be split."""
    least = materialize(edges.groupBy(key).agg(F.least(F.min(other), F.first(key)).alias("m")), "least")
    return edges.join(least, key)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) of every node of (u, v) edges; a component is named by its least node.

    No vertex' neighbours are gathered: each step is an aggregation and a join. Rounds grow with the logarithm of the
    longest chain.
    """
    stars = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = stars.union(stars.select("v", "u"))
        large = _nearest(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-star")
        small = _nearest(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u != v").distinct()
        stars = materialize(small, "small-star")
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
