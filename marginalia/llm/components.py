"""Connected components of a table of links, by alternating star steps.

Each round links every node's larger neighbours to its smallest one, then its smaller
neighbours; after a number of rounds that grows with the logarithm of the largest component all
links point at the smallest node. The links stay a table throughout, stored once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import spread_join, stored

#: Tasks over which the links of a hub are spread.
SALTS = 8


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    told = spread_join(both.where("v > u"), least, ["u"], SALTS, F.col("v"))
    return told.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(links, least, ["a"], SALTS, F.col("b")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); a component is its smallest node.

    Links may be repeated, stand in either order or join a node with itself. Links with a null
    end do not count. No links give no rows.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(a, b).distinct(), "links")
    mark = F.bit_xor(F.xxhash64("a", "b"))
    before = None
    while (now := links.agg(F.count("*"), mark).first()) != before:
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())
