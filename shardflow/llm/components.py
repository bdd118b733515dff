"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of links (a, b); the component is its smallest node.

    Each round is a large-star and a small-star step (every node's larger neighbours, then its smaller ones, are
    linked to its smallest neighbour); the table is written after each round, and rounds end when nothing changes.
    A hub's links are rows, minima are partial aggregates, and a hub's rows reach its minimum by a join that Spark
    can split, so no node's neighbours are gathered in one task.

    Links of a node with itself and links with a null end are left out, repeated links count once, nodes without links
    have no row, an empty table gives an empty one.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # now every a > b: link a and its other smaller neighbours to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
