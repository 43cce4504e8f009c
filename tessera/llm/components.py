"""Connected components of an undirected graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Links of one node that meet by key in one place; the least neighbours of nodes with more are broadcast instead.
HUB = 100_000


def _with_least(links: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """Links (u, v) with the least neighbour m of u. least: u, m, n (links of u); count: links in all.

    A node with many links is no join key: at most 2 * count / hub nodes have more than hub links, so that with this hub
    they are BROADCAST_ROWS at most.
    """
    hub = max(HUB, 2 * count // BROADCAST_ROWS)
    if count <= hub:
        return links.join(least.drop("n"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > hub).drop("n"))
    others = links.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= hub).drop("n"), "u")
    return links.join(hubs, "u").unionAll(others)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node with a link to another; component is the least node reachable.

    edges: two columns of comparable ids, in either direction; loops, repeats and rows with nulls are ignored. Each
    round stars every node's larger neighbours on its least neighbour, then its smaller ones, until nothing changes;
    rounds grow with the logarithm of the graph, and each is stored, so lost executors repeat one round at most.
    """
    a, b = edges.columns
    e = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    now = None
    while True:
        mark, now = now, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tops = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small_star = _with_least(large, tops, now[0]).filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        e = stored(small_star.unionAll(tops.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), "edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
