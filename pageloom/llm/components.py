"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import materialize, salted_join


def _nearest(links: DataFrame) -> DataFrame:
    """Smallest neighbour (or the node itself) per ``a``; combined before the shuffle."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint): root is the smallest node reachable.

    Large-star and small-star rounds: links are turned towards smaller nodes until every node points at
    its root. Each round is written to the shared folder, which cuts the lineage. A node with many
    neighbours is spread over tasks by salted joins. Links to itself and links with null are ignored; no
    link gives no row. Fails if ``max_rounds`` do not settle it; the rounds needed grow with the logarithm of
    the longest chain.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = salted_join(both.filter("b > a"), _nearest(both), ["a"], "inner", "b").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct())
        least = _nearest(large)
        small = salted_join(large, least, ["a"], "inner", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.filter("a <> b").union(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            root = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return root.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
