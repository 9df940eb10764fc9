"""Trees given as edge tables ``(tree_id, node_id, parent_id, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import value_sum
from ..plans.contraction import check_parents
from ..plans.levels import combine_children
from ..session import discard, materialize
from .skew import spread_join
from .tour import rank_edges

#: trees with more levels are numbered by list ranking
LEVELS = 16


def tree_from_edges(edges: DataFrame) -> DataFrame:
    """Check an edge table and add ``depth`` and ``is_leaf``.

    Each round doubles the distance to the known ancestor, so the number of joins is logarithmic in the
    height. Raises for a tree without a root, a missing parent and a cycle.
    """
    nodes = materialize(edges, "edges")
    roots = nodes.groupBy("tree_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n"))
    if not roots.filter("n = 0").isEmpty():
        raise ValueError("root not found")
    check_parents(nodes)

    # inner nodes are the only ancestors, so only they are doubled; leaves hang below them in one last join
    inner = nodes.filter(F.col("parent_id").isNotNull()).select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    jump = nodes.join(inner, ["tree_id", "node_id"], "left_semi").select(
        "tree_id", "node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("d")
    )
    jump = materialize(jump, "jump")
    total, open_rows = jump.count(), jump.filter("up is not null").count()
    reach = 1
    while open_rows:
        if reach > total:
            raise ValueError("the edges have a cycle")
        jump = materialize(_double(jump), "jump")
        reach, open_rows = reach * 2, jump.filter("up is not null").count()
    depth_of = jump.select("tree_id", "node_id", "d")
    families = depth_of.select("tree_id", F.col("node_id").alias("parent_id"), (F.col("d") + 1).alias("depth"))
    inner_flag = depth_of.select("tree_id", "node_id", F.lit(False).alias("is_leaf"), F.col("d"))
    # written once: it is counted, joined to the parents, and read again for the inner nodes
    out = materialize(nodes.join(inner_flag, ["tree_id", "node_id"], "left"), "flagged")
    leaf_depth = _by_parent(out.filter("is_leaf is null").drop("is_leaf", "d"), families)
    kept = out.filter("is_leaf is not null").withColumnRenamed("d", "depth")
    columns = [*edges.columns, "depth", "is_leaf"]
    kept = kept.withColumn("depth", F.col("depth").cast("int")).select(*columns)
    leaves = leaf_depth.select(*edges.columns, F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.lit(True).alias("is_leaf"))
    return kept.unionAll(leaves)


def _by_parent(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join of ``rows`` with per-node ``facts`` on the parent; wide families are spread."""
    return spread_join(rows, facts, ["tree_id", "parent_id"], F.col("node_id"))


def _double(jump: DataFrame) -> DataFrame:
    above = jump.select("tree_id", F.col("node_id").alias("parent_id"), F.col("up").alias("up2"), F.col("d").alias("d2"))
    moving = jump.filter("up is not null").withColumnRenamed("up", "parent_id")
    moved = _by_parent(moving, above).select(
        "tree_id", "node_id", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d")
    )
    return moved.unionAll(jump.filter("up is null"))


def number_edges(nodes: DataFrame, height: int | None = None) -> DataFrame:
    """Token positions for an edge table with ``depth``: adds ``open_pos`` and ``close_pos``.

    Siblings are in ``node_id`` order. Trees of at most ``LEVELS`` levels: subtree sizes are summed bottom-up, level by
    level; then ``open = parent's open + 1 + 2 * (sizes of earlier siblings)`` top-down. Taller ones are ranked as
    bracket lists, in logarithmic rounds. Roots of a forest follow each other.
    """
    # written once: the depths, the bounds of the ranges and the ranges would each derive the table again
    given = materialize(nodes, "given")
    found = given.agg(F.max("depth")).first()[0] or 0
    if height is not None and found > height:
        raise ValueError(f"a node lies deeper than height {height}")
    if found >= LEVELS:
        return rank_edges(given)
    nodes = materialize(_ranged(given), "edges")
    discard(given)
    height = found
    sized: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(height, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, ["tree_id", "node_id"], "left")
        size: Column = F.lit(1).cast("bigint") if below is None else 1 + F.coalesce("v", F.lit(0))
        level = level.withColumn("size", size).drop("v")
        # sizes of earlier siblings: a running sum per family, in ranges so that no family is one task
        level = materialize(_earlier_siblings(level), "sized")
        sized.append(level)
        below = combine_children(
            level.select("tree_id", "parent_id", F.col("node_id").alias("pos"), F.col("size").alias("v")),
            ["tree_id", "parent_id"],
            value_sum,
            0,
        ).withColumnRenamed("parent_id", "node_id")
    placed = sized.pop().withColumn("open_pos", 2 * F.col("earlier"))
    out = placed
    while sized:
        above = placed.select("tree_id", F.col("node_id").alias("parent_id"), F.col("open_pos").alias("up"))
        placed = _by_parent(sized.pop(), above)
        placed = placed.withColumn("open_pos", F.col("up") + 1 + 2 * F.col("earlier")).drop("up")
        if len(sized) % 8 == 7:
            placed = materialize(placed, "placed")
        out = out.unionByName(placed)
    close = F.col("open_pos") + 2 * F.col("size") - 1
    return out.withColumn("close_pos", close).drop("earlier", "size")


def _ranged(nodes: DataFrame) -> DataFrame:
    """Add ``fam`` (the parent) and ``part``: ranges of about equal row counts over families and their members.

    Ids are sparse, so the ranges come from range partitioning. They are written with their number, which makes
    it a fixed fact of the row; a wide family is spread over its ranges.
    """
    rows = nodes.withColumn("fam", F.coalesce("parent_id", F.lit(-1)))
    return rows.repartitionByRange("tree_id", "fam", "node_id").withColumn("part", F.spark_partition_id())


def _earlier_siblings(level: DataFrame) -> DataFrame:
    """Add ``earlier``: the sum of ``size`` over the siblings with smaller ``node_id``."""
    key = ["tree_id", "fam"]
    before = (Window.unboundedPreceding, -1)
    totals = level.groupBy(*key, "part").agg(F.sum("size").alias("t"))
    across = Window.partitionBy(*key).orderBy("part").rowsBetween(*before)
    totals = totals.select(*key, "part", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key, "part").orderBy("node_id").rowsBetween(*before)
    rows = level.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, [*key, "part"])
    return rows.withColumn("earlier", F.col("base") + F.col("run")).drop("fam", "part", "run", "base")
