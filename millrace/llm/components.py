"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.folders import remove_stored, stored


#: Nodes with more neighbours than this, and than ``1 / MOST_HUBS`` of all links, are hubs: a task of its own for one
#: of them would grow with it, so what is known of hubs is broadcast. There are ``2 * MOST_HUBS`` of them at most.
HUB_LINKS = 1000
MOST_HUBS = 100_000


def connected_components(links: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b`` of bigint); the component is its least node.

    Alternating large and small stars: every node with its neighbours is tied to the least of them, first the
    larger neighbours, then the smaller ones, until nothing changes. The number of rounds grows with the logarithm of the
    longest chain. Each round is a table in the shared folder, so that a lost executor costs one round at most; no
    link reaches the driver. Links of a node with itself are no links.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.where("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct())
    state = _summary(edges)
    while True:
        limit = max(hub_links, state[0] // MOST_HUBS)
        both = edges.union(edges.select("b", "a"))
        large = _with_root(both, F.least(F.min("b"), F.first("a")), limit).where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = stored(large)
        small = _with_root(large, F.min("b"), limit)
        moved = small.where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        following = stored(moved.union(small.select("a", "root")).distinct())
        state, before = _summary(following), state
        remove_stored(edges)
        remove_stored(large)
        edges = following
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _with_root(edges: DataFrame, root: Column, limit: int) -> DataFrame:
    """``edges`` with the ``root`` of their first node, an aggregate of its links."""
    roots = edges.groupBy(F.col("a").alias("node")).agg(root.alias("root"), F.count("*").alias("links"))
    hubs = roots.where(F.col("links") > limit).select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    told = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    rest = told.where("hub is null").select("a", "b").join(roots.where(F.col("links") <= limit).select("node", "root"), F.col("a") == F.col("node"))
    return told.where("hub is not null").select("a", "b", F.col("hub_root").alias("root")).union(rest.select("a", "b", "root"))


def _summary(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; two sums of hashes tell different ones apart."""
    hashes = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())
