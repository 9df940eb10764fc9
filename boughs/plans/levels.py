"""Fold of node tables by levels: one grouped aggregation per level, deepest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.algebra import TreeAlgebra
from ..session import discard, materialize
from .contraction import check_parents, fold_rounds
from .pieces import PIECE, rake_pieces

BITS = 12
#: Above this height one shuffle per level is a poor plan; contraction needs a logarithmic number.
TALL = 30
CUT_EVERY = 8
#: ranges that a key may have where all of its ranges come to one task
TOGETHER = 1 << 16


def ordered_reduce(rows: DataFrame, keys: list[str], algebra: TreeAlgebra, top: int) -> DataFrame:
    """Combine ``v`` in ``pos`` order per key, for a ``mult`` that is only associative.

    Positions are cut into ranges of 2**BITS, so no group is larger than that, and the range results are
    combined in the same way until position 0 is all that is left (``top`` is the largest position). Once a key can have
    no more than ``TOGETHER`` ranges they are shuffled by key, and what follows needs no shuffle.
    """
    mult = algebra.need_column("ordered_reduce").mult
    together = False
    while True:
        top >>= BITS
        items = F.array_sort(F.collect_list(F.struct("pos", "v")))
        rows = rows.groupBy(*keys, F.shiftright("pos", BITS).alias("pos")).agg(items.alias("items"))
        value = F.aggregate(
            F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))),
            F.col("items")[0]["v"],
            lambda acc, x: mult(acc, x["v"]),
        )
        rows = rows.select(*keys, "pos", value.alias("v"))
        if not top:
            return rows.select(*keys, "v")
        if top < TOGETHER and not together:
            rows, together = rows.repartition(*keys), True


def combine_children(rows: DataFrame, keys: list[str], algebra: TreeAlgebra, top: int) -> DataFrame:
    """``mult`` over the rows ``(keys, pos, v)`` of each key; map-side combine if the order is free."""
    agg = algebra.need_column("combine_children").agg
    if agg is not None:
        return rows.groupBy(*keys).agg(agg(F.col("v")).alias("v"))
    return ordered_reduce(rows, keys, algebra, top)


def fold_forest(roots: DataFrame, algebra: TreeAlgebra, top: int = 0) -> DataFrame:
    """Root results ``(tree_id, pos, v)`` -> ``(tree_id, value)``."""
    return combine_children(roots, ["tree_id"], algebra, top).select("tree_id", algebra.answer(F.col("v")).alias("value"))


def fold_ordered(nodes: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Node table of ``match_brackets`` -> ``(tree_id, value)`` for an ordered algebra, at any height.

    Every node becomes its opening and its closing factor at their positions, a leaf one factor, and the factors
    of a tree are multiplied in ranges of 2**BITS positions: a number of shuffles that is logarithmic in the size.
    """
    form = algebra.need_wrap("fold_ordered")
    nodes = nodes.select("tree_id", "node_id", "close_pos", "is_leaf", "value")
    top = nodes.agg(F.max("close_pos")).first()[0] or 0
    a, kind = F.col("value"), algebra.result_type
    leaf = F.array(F.struct(F.col("node_id").alias("pos"), form.leaf(a).cast(kind).alias("v")))
    inner = F.array(
        F.struct(F.col("node_id").alias("pos"), form.open(a).cast(kind).alias("v")),
        F.struct(F.col("close_pos").alias("pos"), form.close(a).cast(kind).alias("v")),
    )
    factors = nodes.select("tree_id", F.inline(F.when(F.col("is_leaf"), leaf).otherwise(inner)))
    out = ordered_reduce(factors, ["tree_id"], algebra, top)
    return out.select("tree_id", algebra.answer(F.col("v")).alias("value"))


def fold_star(levels: list[DataFrame], algebra: TreeAlgebra, forest: bool = False) -> DataFrame:
    """Levels ``(node_id, parent_id, value)`` of a star schema, deepest first -> ``(tree_id, value)``.

    Every level is keyed by its own keys. A level is combined per parent before it is joined, so only one row
    per parent goes up, and nothing about the tree comes down: a tree is named by the key of its root, or, for a
    ``forest``, by the parent key of the last level. Leaves need no key. Rows without a parent row are no part of
    any tree.
    """
    form = algebra.need_column("fold_star")
    if form.agg is None:
        raise ValueError(f"fold_star combines children in any order, which {algebra.name!r} does not allow; use fold_levels")
    below: DataFrame | None = None
    for i, rows in enumerate(levels):
        rows = rows.toDF("node_id", "parent_id", "value")
        if below is None:
            value = form.hom(F.col("value"))
        else:
            rows = rows.join(below.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
            value = algebra.node_value(F.col("value"), F.col("v"), F.coalesce("has", F.lit(False)))
        rows = rows.select("node_id", "parent_id", value.alias("v"))
        if i == len(levels) - 1 and not forest:
            return fold_forest(rows.select(F.col("node_id").alias("tree_id"), "v"), algebra)
        below = rows.groupBy("parent_id").agg(form.agg(F.col("v")).alias("v"), F.lit(True).alias("has"))
    return below.select(F.col("parent_id").alias("tree_id"), algebra.answer(F.col("v")).alias("value"))


def _by_depth(nodes: DataFrame) -> DataFrame:
    return nodes.repartitionByRange("depth", "tree_id", "node_id")


def _can_rake(nodes: DataFrame, algebra: TreeAlgebra) -> bool:
    numbers = [nodes.schema[c].dataType for c in ("tree_id", "node_id", "parent_id", "depth")]
    return algebra.batch is not None and algebra.column.agg is not None and all(isinstance(t, T.IntegralType) for t in numbers)


def fold_levels(nodes: DataFrame, algebra: TreeAlgebra, height: int | None = None, piece: int = PIECE) -> DataFrame:
    """``(tree_id, node_id, parent_id, depth, value)`` -> ``(tree_id, value)``.

    With a known ``height`` of a few levels this is one lazy plan, which raises when it meets a deeper node.
    Otherwise the nodes are written, ordered by depth, and parents are checked: each level then reads only its own row
    groups. Trees that go to the contraction are written as they come, since it reads every depth alike. More than
    ``piece`` nodes are first raked inside ranges of their numbers (``pieces.py``), and the levels get what is left.
    """
    algebra.need_column("fold_levels")
    nodes = nodes.select("tree_id", "node_id", "parent_id", "depth", "value")
    top = 0
    if height is None or height > CUT_EVERY:
        may_contract = algebra.affine is not None
        nodes = materialize(nodes if may_contract else _by_depth(nodes), "levels")
        found, top, total = nodes.agg(F.max("depth"), F.max("node_id"), F.count("*")).first()
        if height is not None and (found or 0) > height:
            raise ValueError(f"a node lies deeper than height {height}")
        height, top = found or 0, top or 0
        if height > TALL and may_contract:
            return fold_rounds(nodes, algebra)
        rakes = may_contract and total > piece and _can_rake(nodes, algebra)
        if not rakes:
            check_parents(nodes)
        if may_contract:
            written = [nodes]
            if rakes:
                nodes = rake_pieces(nodes, algebra, total, piece)
                written.append(nodes)
                height = nodes.agg(F.max("depth")).first()[0] or 0
            nodes = materialize(_by_depth(nodes), "levels")
            for earlier in written:
                discard(earlier)
    elif algebra.column.agg is None:
        top = nodes.agg(F.max("node_id")).first()[0] or 0

    raked = "has" in nodes.columns

    def node_value(v: Column, found: Column) -> Column:
        if not raked:
            return algebra.node_value(F.col("value"), v, found)
        s = F.when(found & F.col("has"), algebra.column.mult(F.col("s"), v)).when(found, v).otherwise(F.col("s"))
        return algebra.node_value(F.col("value"), s, F.col("has") | found)

    below: DataFrame | None = None
    for depth in range(height, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if below is None:
            level = nodes.filter(F.col("depth") >= depth)
            deeper = F.raise_error(f"a node lies deeper than height {height}").cast(algebra.result_type)
            nothing = F.lit(None).cast(algebra.result_type)
            leaf: Column = node_value(nothing, F.lit(False)) if raked else algebra.column.hom(F.col("value"))
            value = F.when(F.col("depth") > depth, deeper).otherwise(leaf)
        else:
            level = level.join(below, ["tree_id", "node_id"], "left")
            value = node_value(F.col("v"), F.coalesce("found", F.lit(False)))
        done = level.select("tree_id", "parent_id", F.col("node_id").alias("pos"), value.alias("v"))
        if depth == 0:
            return fold_forest(done.drop("parent_id"), algebra, top)
        below = combine_children(done, ["tree_id", "parent_id"], algebra, top)
        below = below.select("tree_id", F.col("parent_id").alias("node_id"), "v", F.lit(True).alias("found"))
        if (height - depth) % CUT_EVERY == CUT_EVERY - 1:
            below = materialize(below, "level")
    raise AssertionError("unreachable")
