"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import written

#: From so many links on, nodes with over a thousandth of them are joined by broadcast.
MANY = 1_000_000
SHARE = 1000


def _beside_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """edges(u, v) with least's m of u. least: u, m and n, the number of u's edges.

    A join on u gives a task all edges of a node. Hubs, each with more than a thousandth of
    many links, are fewer than two thousand nodes, so their table is broadcast instead and
    their edges stay where they are."""
    if n_edges < MANY:
        return edges.join(least.drop("n"), "u")
    limit = n_edges // SHARE
    hubs = written(least.filter(F.col("n") > limit).drop("n"), "hubs")
    hot = edges.join(F.broadcast(hubs), "u")
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return hot.unionByName(others.join(least.filter(F.col("n") <= limit).drop("n"), "u"))


def stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node of its component.

    Alternates large-star and small-star steps, which hang every node's neighbours on its
    least neighbour and need about log(n) rounds. Each round is written to the shared
    folder, so a lost executor costs one round. A node's minimum is a partial aggregate.
    """
    edges = written(
        links.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links"
    )
    before, n = None, edges.count()
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _beside_least(both, least, n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside_least(down, least, n)
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(step.filter("u <> v").distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        n = now[0]
        if now == before or not n:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
