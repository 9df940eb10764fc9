"""Fold of chunked token files through mating pairs: for trees too deep to merge partials in one task.

A node that is opened in chunk L and closed in a later chunk R belongs to the pair (L, R). The nodes of a
pair are a chain of consecutive depths ``[du, dl)``, and only the deepest one can have other pairs below
it. So every pair is reduced to one affine context and its deepest node, and the pairs form a tree with at
most two nodes per chunk, which is contracted. All steps are joins, windows and grouped aggregations whose
groups are bounded by the length of a chunk or the number of chunk blocks, never by the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import TreeAlgebra
from ..operators.match import CLOSE, ENTRY_ROWS, OPEN, QUERY, match_levels
from ..operators.nearest import visible_pairs
from ..operators.partials import chunk_partial, chunk_shape
from ..operators.scan import BLOCK_BITS, exclusive_scan
from ..operators.shape import HELD_STARTS
from ..session import materialize
from .contraction import SMALL, contract

_LEVEL_BITS = 31

#: partials of a task where they are shuffled; a shuffle cut by bytes gives a task any number that compress well
_PART_CHUNKS = 1 << 13


def chunk_depth(shapes: DataFrame) -> DataFrame:
    """Chunk shapes -> absolute lowest depth of each chunk, and the chunk after it (NULL for the last).

    ``depth`` is the depth before the chunk minus the closes it does not open itself.
    """
    closes = F.col("n_cs") - 1
    rows = shapes.select("*", (F.col("n_abs") - closes).cast("bigint").alias("net"))
    rows = exclusive_scan(rows, ["tree_id"], "chunk_id", {"before": ("net", "sum")})
    rows = rows.withColumn("depth", (F.col("before") - closes).cast("int"))
    return next_chunk(rows.drop("net", "before"))


def next_chunk(rows: DataFrame) -> DataFrame:
    """Add ``next_id``: the following ``chunk_id`` of the tree, searched inside blocks and then across."""
    rows = rows.withColumn("blk", F.shiftright("chunk_id", BLOCK_BITS))
    firsts = rows.groupBy("tree_id", "blk").agg(F.min("chunk_id").alias("first"))
    after = F.lead("first").over(Window.partitionBy("tree_id").orderBy("blk")).alias("next_blk")
    firsts = firsts.select("tree_id", "blk", after)
    here = F.lead("chunk_id").over(Window.partitionBy("tree_id", "blk").orderBy("chunk_id"))
    rows = rows.withColumn("here", here).join(firsts, ["tree_id", "blk"])
    return rows.withColumn("next_id", F.coalesce("here", "next_blk")).drop("blk", "here", "next_blk")


def mating_pairs(depths: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(tree_id, chunk_id, depth)`` -> pairs ``(tree_id, off_l, off_r, du, dl)``; NULL ``dl`` = innermost.

    Neighbouring chunks always mate. Two others mate where all chunks between them lie deeper than both: each such pair
    belongs to the deepest-reaching chunk between them, whose nearest smaller depths are its two chunks. So there
    are fewer than two pairs per chunk, whatever the height of the tree.
    """
    seen = visible_pairs(depths.select("tree_id", F.col("chunk_id").alias("c"), F.col("depth").alias("d")), block_bits)
    seen = seen.filter(F.col("hi").isNull() | (F.col("dr") < F.col("hi")))
    return seen.select(
        "tree_id", F.col("k").alias("off_l"), F.col("r").alias("off_r"), F.greatest("dk", "dr").cast("int").alias("du"),
        F.col("hi").cast("int").alias("dl"),
    )


def pair_tree(pairs: DataFrame) -> DataFrame:
    """Add the parent pair: the last pair with ``dl`` = the child's ``du`` that starts no later.

    Pairs with one ``dl`` do not overlap, so this as-of lookup per depth replaces the containment join.
    """
    opens = pairs.filter("dl is not null").select(
        "tree_id", F.col("dl").alias("level"), (F.col("off_l") * 2).alias("c"), F.lit(OPEN).alias("kind"),
        F.col("off_r").alias("pos"), *[F.lit(None).cast("bigint").alias(c) for c in ("off_l", "off_r")],
        *[F.lit(None).cast("int").alias(c) for c in ("du", "dl")],
    )
    asks = pairs.select(
        "tree_id", F.col("du").alias("level"), (F.col("off_l") * 2 + 1).alias("c"), F.lit(QUERY).alias("kind"),
        F.lit(None).cast("bigint").alias("pos"), "off_l", "off_r", "du", "dl",
    )
    found = match_levels(opens.unionAll(asks))
    return found.select(
        "tree_id", "off_l", "off_r", "du", "dl",
        F.expr("ref.c div 2").alias("parent_l"), F.col("ref.pos").alias("parent_r"),
    )


def with_facts(partials: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """Partials with the facts of their chunks, ``n`` in all.

    Up to ``HELD_STARTS`` chunks the facts are broadcast, so partials stay where they are; beyond that a shuffle, cut by
    their number, brings both together.
    """
    key = ["tree_id", "chunk_id"]
    if n <= HELD_STARTS:
        return partials.join(F.broadcast(facts), key)
    # merged: a few MB of partials may be millions of entries, too many to broadcast
    return partials.repartition(-(-n // _PART_CHUNKS), *key).join(facts.hint("merge"), key)


def _exploded(partials: DataFrame, depths: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """One row per entry of each partial, on the level of the node it belongs to. The depths are written."""
    rows = with_facts(partials, depths.select("tree_id", "chunk_id", "depth"), depths.count())
    none_a = F.lit(None).cast(algebra.value_type)
    cs = F.transform(
        "cs",
        lambda x, j: F.struct(
            (F.col("depth") + j - 1).alias("level"), F.when(j == 0, QUERY).otherwise(CLOSE).alias("kind"),
            none_a.alias("a"), x["v"].alias("v"), x["has"].alias("has"),
        ),
    )
    opens = F.transform(
        "abs",
        lambda x, j: F.struct(
            (F.col("depth") + j).alias("level"), F.lit(OPEN).alias("kind"),
            x["a"].alias("a"), x["v"].alias("v"), x["has"].alias("has"),
        ),
    )
    c = F.col("chunk_id").alias("c")
    return rows.select("tree_id", c, F.col("chunk_id").alias("pos"), F.inline(F.concat(cs, opens)))


def pair_pieces(partials: DataFrame, depths: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """Pieces of the nodes that span chunks: ``(tree_id, side, node_c, level, chunk_id, a, v, has)``.

    ``side`` is ``left`` (value and finished children in the opening chunk), ``right`` (children in the
    closing chunk) or ``middle`` (children in a chunk between them). ``node_c`` is the opening chunk; it is NULL
    for ``middle`` pieces outside any node, which are results of roots.
    """
    rows = materialize(_exploded(partials, depths, algebra), "entries", file_rows=ENTRY_ROWS)
    left = rows.filter(F.col("kind") == OPEN).select(
        "tree_id", F.lit("left").alias("side"), F.col("c").alias("node_c"), "level", "c", "a", "v", "has"
    )
    found = match_levels(rows).select(
        "tree_id",
        F.when(F.col("kind") == CLOSE, "right").otherwise("middle").alias("side"),
        F.when((F.col("kind") == CLOSE) & F.col("ref").isNull(), F.raise_error("unbalanced tree: extra close"))
        .otherwise(F.col("ref.c"))
        .alias("node_c"),
        "level",
        "c",
        "a",
        "v",
        "has",
    )
    return left.unionAll(found).withColumnRenamed("c", "chunk_id")


def pair_triplets(pieces: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """One row per node: ``(tree_id, node_c, level, close_c, a, s, has)``, ``s`` over all its finished children."""
    rows = pieces.filter(F.col("node_c").isNotNull())
    out = rows.groupBy("tree_id", "node_c", "level").agg(
        F.max(F.when(F.col("side") == "right", F.col("chunk_id"))).alias("close_c"),
        F.first("a", ignorenulls=True).alias("a"),
        algebra.column.agg(F.when(F.col("has"), F.col("v"))).alias("s"),
        F.bool_or("has").alias("has"),
    )
    unclosed = F.raise_error("unbalanced tree: unclosed open")
    return out.withColumn("close_c", F.when(F.col("close_c").isNull(), unclosed).otherwise(F.col("close_c")))


def compose_pairs(triplets: DataFrame, algebra: TreeAlgebra) -> DataFrame:
    """One row per pair: ``(tree_id, off_l, off_r, du, dl, k, p, wrapped, a, s, has)``.

    ``(k, p)`` is the composed context of all nodes of the pair but the deepest, whose ``a, s, has`` stay open
    until the pairs below it are known. A pair has at most as many nodes as its chunk has tokens.
    """
    affine = algebra.need_affine("compose_pairs")

    def context(k: Column, p: Column) -> Column:
        return F.struct(k.cast(algebra.result_type).alias("k"), p.cast(affine.p_type).alias("p"))

    nodes = F.array_sort(F.collect_list(F.struct("level", "a", "s", "has")))
    rows = triplets.groupBy("tree_id", "node_c", "close_c").agg(nodes.alias("nodes"))
    upper = F.transform(
        F.slice("nodes", 1, F.size("nodes") - 1),
        lambda e: context(*affine.of_node(e["a"], F.when(e["has"], e["s"]))),
    )
    rows = rows.select("*", upper.alias("upper"), F.element_at("nodes", -1).alias("deep"))
    composed = F.aggregate(
        F.slice("upper", 2, F.greatest(F.size("upper") - 1, F.lit(0))),
        F.get("upper", F.lit(0)),
        lambda u, l: context(*affine.compose(u["k"], u["p"], l["k"], l["p"])),
    )
    rows = rows.withColumn("ctx", composed)
    return rows.select(
        "tree_id", F.col("node_c").alias("off_l"), F.col("close_c").alias("off_r"),
        F.col("nodes")[0]["level"].alias("du"), (F.col("deep.level") + 1).alias("dl"),
        "ctx.k", "ctx.p", (F.size("upper") > 0).alias("wrapped"), "deep.a", "deep.s", "deep.has",
    )


def _id(chunk: Column, level: Column) -> Column:
    return F.shiftleft(chunk.cast("bigint"), _LEVEL_BITS).bitwiseOR(level.cast("bigint"))


def fold_pairs(chunks: DataFrame, algebra: TreeAlgebra, small: int = SMALL) -> DataFrame:
    """``(tree_id, chunk_id, tokens)`` -> ``(tree_id, value)``; commutative algebras, any depth."""
    algebra.need_affine("fold_pairs")
    return fold_pair_partials(materialize(chunk_partial(chunks, algebra), "partials"), algebra, small)


def fold_pair_partials(partials: DataFrame, algebra: TreeAlgebra, small: int = SMALL) -> DataFrame:
    depths = materialize(chunk_depth(chunk_shape(partials)), "depths")
    if (depths.agg(F.max("chunk_id")).first()[0] or 0) >= 1 << 32:
        raise ValueError("chunk_id must be below 2**32 for fold_pairs; number the chunks densely")
    pieces = materialize(pair_pieces(partials, depths, algebra), "pieces")
    pairs = compose_pairs(pair_triplets(pieces, algebra), algebra)

    # the node above a pair: opened in the same chunk, or found by the chunk's query at its lowest point
    above = pieces.filter(F.col("side") == "middle").select(
        "tree_id", F.col("chunk_id").alias("off_l"), (F.col("level") + 1).alias("depth"), F.col("node_c").alias("up_c")
    )
    rows = pairs.join(above, ["tree_id", "off_l"])
    same = F.col("du") > F.col("depth")
    parent = F.when(same, _id(F.col("off_l"), F.col("du") - 1)).when(
        F.col("up_c").isNotNull(), _id(F.col("up_c"), F.col("du") - 1)
    )
    state = rows.select(
        "tree_id", _id(F.col("off_l"), F.col("dl") - 1).alias("id"), parent.alias("parent"),
        "k", "p", "wrapped", "a", "s", "has",
    )
    roots = contract(state, algebra, small)
    loose = pieces.filter(F.col("node_c").isNull() & F.col("has")).select("tree_id", "v")
    value = algebra.column.agg(F.col("v")).alias("value")
    roots = roots.unionAll(loose).groupBy("tree_id").agg(value)
    return roots.select("tree_id", algebra.answer(F.col("value")).alias("value"))
