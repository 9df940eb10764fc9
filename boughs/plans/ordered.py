"""Fold of chunked token files for algebras whose ``mult`` is only associative, at any height.

With a :class:`WrapForm`, the result of a tree is one ordered product over its brackets. Chunk partials give the
factors: what a chunk finished on each level, and a bracket for each node that it leaves open or closes for an earlier
chunk. The entries of all partials are rows ``(tree, level, chunk)``; a close finds its open by the bracket search in
chunk blocks, level by level, so opens of one range of chunks cancel with closes of another wherever they lie. The
factors, numbered by their place in the tree, are then multiplied in ranges of 2**BITS places.

Sibling order is the order of places. No step gathers the levels of a tree, the chunks of a level or the children of a
node in one task: windows hold a level of one block of chunks or one row per block, groups one node or one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import TreeAlgebra
from ..operators.match import CLOSE, ENTRY_ROWS, OPEN, QUERY, match_levels
from ..operators.partials import chunk_partial, chunk_shape
from ..operators.scan import exclusive_scan
from ..session import materialize
from .levels import ordered_reduce
from .pairs import chunk_depth, with_facts


def fold_ordered_chunks(chunks: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """``(tree_id, chunk_id, tokens)`` -> ``(tree_id, value)`` for an algebra with a wrap form, at any height."""
    algebra.need_wrap("fold_ordered_chunks")
    partials = materialize(chunk_partial(chunks, algebra), "partials")
    depths = materialize(chunk_depth(chunk_shape(partials)), "depths")
    return fold_ordered_partials(partials, depths, algebra)


def partial_entries(partials: DataFrame, depths: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """One row per entry of each partial: ``(tree_id, c, kind, level, pos, a, v, has, inner)``.

    ``pos`` orders the factors of a tree. OPEN: a node left open at ``pos`` and what its finished children multiply to,
    at ``pos + 1``. CLOSE: what the chunk adds to a node of an earlier chunk, at ``pos``, and its close at ``pos + 1``.
    QUERY: what the chunk finishes below its lowest node, at ``pos``; ``level`` is that of the enclosing node. ``inner``
    tells that the next deeper node of this row's node is open at the end of the chunk, so that the node has a child.
    """
    start = depths.withColumn("n_factors", 2 * (F.col("n_cs") + F.col("n_abs")))
    start = exclusive_scan(start, ["tree_id"], "chunk_id", {"start": ("n_factors", "sum")})
    rows = with_facts(partials, start.select("tree_id", "chunk_id", "depth", "start"), depths.count())
    none_a = F.lit(None).cast(algebra.value_type)
    n_cs, n_abs = F.size("cs"), F.size("abs")
    cs = F.transform(
        "cs",
        lambda x, j: F.struct(
            F.when(j == 0, QUERY).otherwise(CLOSE).alias("kind"), (F.col("depth") + j - 1).cast("int").alias("level"),
            (F.col("start") + 2 * (n_cs - 1 - j)).alias("pos"), none_a.alias("a"), x["v"].alias("v"),
            x["has"].alias("has"), ((j == 0) & (n_abs > 0)).alias("inner"),
        ),
    )
    opens = F.transform(
        "abs",
        lambda x, j: F.struct(
            F.lit(OPEN).alias("kind"), (F.col("depth") + j).cast("int").alias("level"),
            (F.col("start") + 2 * (n_cs + j)).alias("pos"), x["a"].alias("a"), x["v"].alias("v"),
            x["has"].alias("has"), (j < n_abs - 1).alias("inner"),
        ),
    )
    return rows.select("tree_id", F.col("chunk_id").alias("c"), F.inline(F.concat(cs, opens)))


def bracket_factors(entries: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """``(tree_id, pos, v)``: the factors of every tree. Raises for unbalanced input."""
    form, kind = algebra.need_wrap("bracket_factors"), algebra.result_type
    found = match_levels(entries)
    extra = F.raise_error("unbalanced tree: extra close").cast("bigint")
    node = F.when((F.col("kind") == CLOSE) & F.col("ref").isNull(), extra).otherwise(F.col("ref.c")).alias("node")
    # what is known of a node, from its own row, its close, and every chunk whose lowest point lies in it
    own = entries.filter(F.col("kind") == OPEN).select(
        "tree_id", F.col("c").alias("node"), "level", F.col("pos").alias("open"), "a",
        F.lit(None).cast("bigint").alias("close"), (F.col("has") | F.col("inner")).alias("has"),
    )
    given = found.select(
        "tree_id", node, "level", F.lit(None).cast("bigint").alias("open"),
        F.lit(None).cast(algebra.value_type).alias("a"),
        F.when(F.col("kind") == CLOSE, F.col("pos") + 1).alias("close"), (F.col("has") | F.col("inner")).alias("has"),
    )
    nodes = own.unionByName(given.filter(F.col("node").isNotNull())).groupBy("tree_id", "node", "level").agg(
        F.max("open").alias("open"), F.first("a", ignorenulls=True).alias("a"), F.max("close").alias("close"),
        F.bool_or("has").alias("has"),
    )
    unclosed = F.raise_error("unbalanced tree: unclosed open").cast("bigint")
    nodes = nodes.withColumn("close", F.when(F.col("close").isNull(), unclosed).otherwise(F.col("close")))

    def factor(pos, value):
        return F.struct(pos.cast("bigint").alias("pos"), value.cast(kind).alias("v"))

    a = F.col("a")
    both = F.array(factor(F.col("open"), form.open(a)), factor(F.col("close"), form.close(a)))
    brackets = nodes.select(
        "tree_id", F.inline(F.when(F.col("has"), both).otherwise(F.array(factor(F.col("open"), form.leaf(a)))))
    )
    place = F.col("pos") + (F.col("kind") == OPEN).cast("int")
    return brackets.unionByName(entries.filter("has").select("tree_id", place.alias("pos"), "v"))


def fold_ordered_partials(partials: DataFrame, depths: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    entries = materialize(partial_entries(partials, depths, algebra), "entries", file_rows=ENTRY_ROWS)
    top = entries.agg(F.max("pos")).first()[0] or 0
    out = ordered_reduce(bracket_factors(entries, algebra), ["tree_id"], algebra, top + 1)
    return out.select("tree_id", algebra.answer(F.col("v")).alias("value"))
