"""Connected components of a distributed graph by alternating large-star and small-star steps.

Both steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) are an aggregate
of each node's smallest neighbour and a join of the links with it. The aggregate combines before it
shuffles and the join can be split where a node has very many links, so no task holds all links of
a node. Links never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import cut_lineage


def _distinct(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") > F.col("b")).groupBy("a", "b").agg(F.lit(1).alias("_")).select("a", "b")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one, itself included."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _distinct(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.unionByName(least.withColumnRenamed("m", "b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest node."""
    now = cut_lineage(_distinct(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))))
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
    before, after = None, state(now)
    while before != after:
        now = cut_lineage(_small_star(_large_star(now)))
        before, after = after, state(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.groupBy("component").agg(F.lit(1).alias("_")).select(F.col("component").alias("node"), "component"))
