"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.common import BROADCAST_ROWS, discard, stored

#: A node of more links is a hub: its least neighbour is broadcast, so that its links needn't meet in one task.
HUB = 10_000


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal marks of two rounds mean that nothing changed."""
    x = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(x, 20)).alias("a"), F.bit_xor(x).alias("b")).first()
    return tuple(row)


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, m): the edges with the least v of their u, for at most n values of u.

    Minima are partial aggregates. They are broadcast if n is small enough; else those of hubs are, of which there is
    one for HUB edges at most, and the others are joined by a shuffle in which no u has more than HUB rows.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    if n <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hubs = F.broadcast(least.where(F.col("c") > HUB).select("u", F.col("m").alias("hub")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.where("hub is null").select("u", "v").join(least.where(F.col("c") <= HUB).select("u", "m"), "u")
    return rest.unionByName(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node with the node's least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node's smaller neighbours, and the node itself, with the least of them. Needs u > v."""
    moved = _with_least(edges, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(edges.groupBy("u").agg(F.min("v").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): for every node that has an edge, the least node it is linked with.

    Nodes may be of any ordered type; self-links and repeated links are harmless, links with a null end are dropped.
    No edges: no rows. Each round is written to the shared folder, which the next one clears; the number of rounds is
    logarithmic in the component's diameter.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, seen = stored(now.distinct(), "links"), None
    while True:
        mark = _mark(now)
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        stars = stored(_large_star(now, 2 * mark[0]).distinct(), "stars")
        after = stored(_small_star(stars, 2 * mark[0]).distinct(), "links")
        discard(now)
        discard(stars)
        now = after
