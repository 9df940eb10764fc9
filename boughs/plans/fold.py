"""One entry point for chunked token files: picks the strategy that stays within task memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import TreeAlgebra
from ..operators.partials import chunk_partial, chunk_shape
from ..operators.skew import spread_join
from ..session import materialize
from .chunks import fold_partials
from .ordered import fold_ordered_partials
from .pairs import chunk_depth, fold_pair_partials

#: Entries of a merged partial that one task may hold; a merge holds FAN_IN partials of this size.
ENTRY_LIMIT = 1 << 15


#: Entries up to which an algebra without a form for tall trees is merged anyway.
MERGE_LIMIT = 1 << 24


def fold_tree(chunks: DataFrame, algebra: TreeAlgebra, entry_limit: int = ENTRY_LIMIT, merge_limit: int = MERGE_LIMIT) -> DataFrame:
    """Ordered merge for trees of bounded height, another plan for the others; ``(tree_id, value)``.

    A merged partial has at most two entries per tree level, so the largest depth that a chunk touches bounds it. Trees
    above ``entry_limit`` take the pair plan if the algebra is commutative and has an affine form, or the ordered product
    over brackets if it has a wrap form. An algebra with neither is merged up to ``merge_limit`` entries; beyond it raises.
    """
    partials = materialize(chunk_partial(chunks, algebra), "partials")
    depths = materialize(chunk_depth(chunk_shape(partials)), "depths")
    reach = F.col("depth") + F.greatest(F.col("n_abs"), F.col("n_cs"))
    heights = materialize(depths.groupBy("tree_id").agg(F.max(reach).alias("reach")), "heights")
    largest = (heights.agg(F.max("reach")).first()[0] or 0) * 2
    if largest <= entry_limit:
        return fold_partials(partials, algebra)
    paired = algebra.affine is not None and algebra.commutative
    if not paired and algebra.wrap is None:
        if largest > merge_limit:
            raise ValueError(
                f"a tree has partials of {largest} entries, too many to merge in one task: give {algebra.name!r} an affine form"
                " if it is commutative, or a wrap form"
            )
        return fold_partials(partials, algebra)
    tall = F.col("reach") * 2 > entry_limit

    def split(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        routed = materialize(spread_join(rows, heights, ["tree_id"], F.col("chunk_id")), label)
        return routed.filter(~tall).drop("reach"), routed.filter(tall).drop("reach")

    low, high = split(partials, "routed")
    merged = fold_partials(low, algebra)
    if paired:
        return merged.unionAll(fold_pair_partials(high, algebra))
    return merged.unionAll(fold_ordered_partials(high, split(depths, "routed-depths")[1], algebra))
