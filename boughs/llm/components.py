"""Connected components of an edge table, by large-star and small-star rounds.

Each round replaces the edges by shorter ones towards the smallest node, in two aggregations and two joins;
a component becomes a star after a number of rounds that grows with the logarithm of its size. The edges are
written after every round, so a lost executor repeats one round only. Nothing but two sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _to_smallest(edges: DataFrame) -> DataFrame:
    """For each node of ``a``: its neighbours ``b`` and the smallest of them and itself."""
    best = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(best.select("a", F.least("a", "m").alias("m")), "a")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _to_smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = _to_smallest(large)
    small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge table ``a, b``; the root is the smallest node of the component.

    Self loops are ignored: a node without another neighbour is not listed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, longer = mark, edges
        edges = materialize(_round(longer), "edges")
        discard(longer)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
