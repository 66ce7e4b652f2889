"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours. Counting by node is combined before
    the shuffle, and a hub's rows can be split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return pairs.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component: every node with a link, and the smallest node it reaches.

    ``links``: u, v of an integer type; self links and repeated links are allowed. Each
    round is written to the shared folder. It ends when a round changes nothing: then each
    node has one edge, to its component. Without links the result is empty.
    """
    edges = materialize(links.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        last, edges = edges, materialize(small_star(large_star(edges)), "stars")
        release(last)
        if (now := _digest(edges)) == before:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
