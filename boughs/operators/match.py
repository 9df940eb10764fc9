"""Match opens and closes that are not in the same chunk.

Rows are ``(tree_id, level, c, kind, pos)`` where ``c`` is the chunk number and ``kind`` is CLOSE (an unmatched
close of the chunk), QUERY (which node is open on this level when the chunk is at its lowest point?) or
OPEN (a node left open). Within one level opens and closes alternate, and a chunk has at most one row of
each kind per level, so the node that a close or a query belongs to is simply the last open before it.

The search runs in two steps like the scans: inside blocks of chunks, and then over one row per
(level, block). A star-shaped tree, whose chunks all meet on one level, is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import BLOCK_BITS

CLOSE, QUERY, OPEN = 0, 1, 2

#: rows of a file of written entries: numbers in order take a byte or two each, so a file of bytes would hold too many
ENTRY_ROWS = 1 << 16


def match_levels(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """CLOSE and QUERY rows with ``ref``, the ``struct(c, pos)`` of their open (NULL if there is none)."""
    keys = ["tree_id", "level"]
    rows = rows.withColumn("__blk", F.shiftright("c", block_bits))
    node = F.when(F.col("kind") == OPEN, F.struct("c", "pos"))
    before = (
        Window.partitionBy(*keys, "__blk").orderBy("c", "kind").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("__ref", F.last(node, ignorenulls=True).over(before))

    # what a block leaves open on a level: its last open, unless a close comes later
    ends = rows.groupBy(*keys, "__blk").agg(
        F.max(F.when(F.col("kind") != QUERY, F.struct("c", "kind", "pos"))).alias("e")
    )
    left_open = F.when(F.col("e.kind") == OPEN, F.struct("e.c", "e.pos"))
    across = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select(*keys, "__blk", F.last(left_open, ignorenulls=True).over(across).alias("__in"))

    inbound = local.filter(F.col("kind") != OPEN).join(inherited, [*keys, "__blk"])
    return inbound.withColumn("ref", F.coalesce("__ref", "__in")).drop("__blk", "__ref", "__in")
