"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._util import cut, discard


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a long, b long) without nulls. Returns (node, root), root the smallest node reachable, for every node with a link to another.

    Each step keeps at most as many links as there are, whatever a component's size; a node's links are only
    aggregated, never collected. Rounds grow with the logarithm of the largest component.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are shuffled plainly and a node with most links is split.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(low.select("a", F.col("m").alias("b")).union(small).where("a <> b").distinct(), links)
        discard(least)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
